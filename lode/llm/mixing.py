"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's target is its share of all words, capped at a number of repeats. The words to take are
divided into equal blocks; the blocks are dealt to sources by highest quotients target/(2k + 1), and
each source's blocks are dealt to its shards in the same way, so that every shard has an integer
quota. In a shard the documents stand in a seeded order, end to end; the quota takes the whole shard
as often as it fits, and the rest is a run of blocks from a seeded start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small, unused

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block, the same for all sources and sizes; what a source gets is off its target by half a block or so.
BLOCK_WORDS = 4
SEED = 20_240_601
#: Documents of a shard, on average, at least; a source has as many shards as its documents need.
SHARD_DOCS = 1_000
#: Shards in all, about, at most, besides one for each source: this bounds what apportionment holds.
MOST_SHARDS = 100_000
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def capped_targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds most x size is shared by weight among the others."""
    left, open_, out = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes/(2k + 1), k seats had so far; ties to the earlier entry.

    The divisor is found by bisection; the last few seats go to the highest quotients that are left,
    in one sort. So the time does not depend on the number of seats, nor on ties.
    """
    votes = np.asarray(votes, float)
    got = np.zeros(len(votes), np.int64)
    if seats <= 0 or not (votes > 0).any():
        return got
    high, low = 2 * votes.max() + 1, votes.sum() / (seats + len(votes)) / 4
    deal = lambda d: np.floor(votes / d + 0.5).astype(np.int64)  # noqa: E731  quotients over d/2
    for _ in range(200):
        mid = (low + high) / 2
        if deal(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = deal(high)
    while (left := seats - int(got.sum())) > 0:
        got[np.argsort(-votes / (2 * got + 1), kind="stable")[: min(left, int((votes > 0).sum()))]] += 1
    return got


def word_count(col: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(col, F.lit("")), _SPACE), "")).cast("long")


def _quotas(spark: SparkSession, per_shard: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Per source: size and target. Per source and shard: words to take.

    The first apportionment needs one row of each source on the driver: the number of sources, not
    of documents. The second runs per source, over its shards, of which there are MOST_SHARDS at most.
    """
    rows = per_shard.groupBy("source").agg(F.sum("words").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    targets = capped_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    blocks = sainte_lague(np.array(targets), round(sum(sizes) / block_words))
    plan = spark.createDataFrame([(r["source"], s, t, int(b)) for r, s, t, b in zip(rows, sizes, targets, blocks, strict=True)], "source string, source_size long, target double, blocks long")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = pdf["words"].to_numpy()
        quota = np.minimum(sainte_lague(words, int(pdf["blocks"].iloc[0])) * block_words, MOST_REPEATS * words)
        return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "words": pdf["words"], "quota": quota})

    join = per_shard["source"].eqNullSafe(plan["source"])
    shards = per_shard.join(small(plan, len(rows)), join).select(per_shard["source"], "shard", "words", "blocks")
    return plan.select("source", "source_size", "target"), shards.groupBy("source").applyInPandas(deal, "source string, shard int, words long, quota long")


def _placed(rows: DataFrame, scratch: Scratch, seed: int, block_words: int, shard_docs: int) -> DataFrame:
    """(row, doc_id, text, source) -> row and the columns of ``mix``."""
    spark = rows.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    counted = rows.select("row", "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order.alias("order"))
    counted = scratch.table(counted, "counted")
    by = scratch.table(counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs")), "sources")  # a row per source
    totals = by.agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("n")).first()
    per = max(shard_docs, -(-(totals["docs"] or 0) // MOST_SHARDS))
    shards = by.select(F.col("source").alias("s_source"), F.ceil(F.col("docs") / F.lit(per)).alias("n_shards"))
    sized = counted.join(small(shards, totals["n"]), counted.source.eqNullSafe(shards.s_source)).select("row", "doc_id", "source", "size", "order", F.pmod("order", "n_shards").cast("int").alias("shard"))
    per_shard = scratch.table(sized.groupBy("source", "shard").agg(F.sum("size").alias("words")), "per-shard")
    plan, quotas = _quotas(spark, per_shard, block_words)
    quotas = scratch.table(quotas, "quotas")
    q = quotas.withColumnRenamed("source", "q_source").withColumnRenamed("shard", "q_shard")
    within_shard = "partition by source, shard order by order, doc_id, size, row rows between unbounded preceding and current row"
    placed = sized.withColumn("upto", F.expr(f"sum(size) over ({within_shard})")).withColumn("place", F.col("upto") - F.col("size"))
    placed = placed.join(small(q, quotas.count()), placed.source.eqNullSafe(q.q_source) & (placed.shard == q.q_shard))
    words = F.greatest(F.col("words"), F.lit(1))
    n_blocks = F.ceil(words / F.lit(block_words)).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), n_blocks) * block_words
    placed = placed.withColumn("run_words", F.pmod("quota", words)).withColumn("run_from", F.when(F.col("run_words") > 0, start).otherwise(F.lit(0)))
    within = lambda a, b: F.greatest(F.lit(0), F.least(F.col("upto"), b) - F.greatest(F.col("place"), a))
    till = F.col("run_from") + F.col("run_words")
    taken = F.col("size") * F.floor(F.col("quota") / words) + within(F.col("run_from"), till) + within(F.col("run_from") - words, till - words)
    placed = placed.withColumn("taken", taken.cast("long"))
    p = plan.withColumnRenamed("source", "p_source")
    return placed.join(small(p, totals["n"]), placed.source.eqNullSafe(p.p_source)).select(
        "row", "doc_id", "size", "source", "source_size", "target", "taken", "shard", "place", "run_from", "run_words", F.col("words").alias("shard_words")
    )


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, text, source, ...) -> doc_id, size, source, source_size, target, taken, shard, place, run_from, run_words, shard_words.

    Sources stand in code point order with null last and weigh 5, 2, 1, repeating; their targets share
    100 % of all words and stop at 3 times the source. taken counts the words the mix takes of a
    document, repeats included: the words of its shard from ``run_from`` on, ``run_words`` of them
    around the shard's end, and whole passes before. Null text has no words; documents without words
    take none. Repeated rows are documents of their own; which of them stands first in the order of
    (seeded hash of doc_id and text, doc_id, size) makes no difference to the rows that come out. The
    result depends on rows and seed only, not on partitions. Whole texts are counted, however long;
    other columns are not read, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source")
    return _placed(rows, scratch, seed, block_words, shard_docs).drop("row")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``: a document that is taken k times over comes k times.

    Of a document that is taken in part, the part taken is one or two runs of its words; each comes
    as a row with the words of that run, joined by single spaces. A row keeps its other columns; an
    ``n_chars`` column is set to the new length. Null and wordless texts take no words and go. Rows are
    written with a number each and come by number, so that null and repeated ids, and rows that repeat
    under one source or several, have what ``mix`` takes of each. Columns may have any names; an empty
    table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    cols = docs.columns
    row_, at_, piece_ = unused(cols, "row", "at", "piece")
    numbered = scratch.table(docs.withColumn(row_, F.monotonically_increasing_id()), "numbered")
    got = _placed(numbered.select(F.col(row_).alias("row"), "doc_id", "text", "source"), scratch, seed, BLOCK_WORDS, SHARD_DOCS).filter("taken > 0")
    end, till = F.col("place") + F.col("size"), F.col("run_from") + F.col("run_words")

    def run(shift) -> Column:  # the words of a document within the run, in its own counting
        a = F.greatest(F.col("place"), F.col("run_from") - shift)
        return F.struct((a - F.col("place")).alias("at"), F.greatest(F.lit(0), F.least(end, till - shift) - a).alias("n"))

    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    parts = F.when(F.col("taken") % F.col("size") == 0, F.array().cast("array<struct<at:bigint,n:bigint>>")).otherwise(F.array(run(F.lit(0)), run(F.col("shard_words"))))
    pieces = F.concat(F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("at"), F.col("size").alias("n")), whole), F.filter(parts, lambda p: (p["n"] > 0) & (p["n"] < F.col("size"))))
    got = got.select("row", "size", F.explode(pieces).alias("p")).select(F.col("row").alias(at_), F.struct("p.at", "p.n", "size").alias(piece_))
    rows = numbered.join(scratch.table(got, "pieces"), F.col(row_) == F.col(at_))
    p = F.col(piece_)
    words = F.array_remove(F.split("text", _SPACE), "")
    text = F.when(p["n"] == p["size"], F.col("text")).otherwise(F.array_join(F.slice(words, (p["at"] + 1).cast("int"), p["n"].cast("int")), " "))
    out = rows.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)
