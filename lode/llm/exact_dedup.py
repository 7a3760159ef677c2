"""Exact deduplication by deterministic block naming.

Texts are cut into fixed-size blocks of bytes. The distinct blocks are sorted and numbered 0, 1, 2, ...
so that a block has one integer name, whatever the number of partitions. Then adjacent names are
paired, the distinct pairs are sorted and numbered in turn, and so on until each text has a single
name. Names come from sorting contents, never from hashes, so two texts get one identity only if they
are identical: a hash stands in the sort order only.

A text whose (byte length, 64-bit hash) no other row has is alone by itself: the hash only ever
separates texts. Naming runs on the others, so that texts without a partner are not shuffled. Rows
are told apart by number, not by id or digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, matched, small, unused

BLOCK_BYTES = 4096
#: Blocks are sorted by so many first bytes, then by a hash, so that blocks that begin alike are dealt
#: to several partitions too, then by all their bytes.
PREFIX_BYTES = 32
#: Names of frequent blocks that are broadcast, at most: with their blocks some 8 MB.
FREQUENT_BLOCKS = 2_000
ALONE = -1


def _numbered(keys: DataFrame, scratch: Scratch, name: str, cols: list[str], by: list[Column] | None = None) -> DataFrame:
    """Distinct keys, the number ``times`` of each, and their places in the sorted order of all, as ``name``: in the order of ``by``, then of the keys.

    A range sort gives each partition a run of keys; a key's place is its place in the run and the
    lengths of the runs before. The table of runs has a row per partition. Ranges are cut at values of
    ``by`` that Spark samples, so these should be short.
    """
    by = by or [F.col(c) for c in cols]
    ranged = keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("times")).repartitionByRange(*by).sortWithinPartitions(*by, *cols)
    # the number has the partition in its upper bits and the place in the partition in its lower 33
    runs = scratch.table(ranged.withColumn("at", F.monotonically_increasing_id()), f"{name}-runs")
    part = F.shiftright("at", 33)
    lengths = runs.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = lengths.select("part", F.expr("sum(n) over (order by part rows between unbounded preceding and current row) - n").alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = scratch.table(runs.withColumn("part", part).join(F.broadcast(before), "part").select(*cols, "times", place.alias("name")), name)
    scratch.drop(f"{name}-runs")
    return out


def block_identities(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, n, pos, block): the n blocks of each text -> (row, level, name): equal (level, name), equal texts.

    Each level halves the names of a text, so the number of levels follows the logarithm of the
    longest text.
    """
    names = _numbered(blocks, scratch, "names-0", ["block"], [F.substring("block", 1, PREFIX_BYTES), F.xxhash64("block")])
    longest, total = blocks.agg(F.max("n"), F.count(F.lit(1))).first()
    most = longest or 1
    at = F.xxhash64("row", "pos")
    named = matched(blocks, names, ["block"], "times", total, at, FREQUENT_BLOCKS)
    current, done, level = scratch.table(named.select("row", "n", "pos", "found.name"), "named-0"), [], 0
    for level in range(1, math.ceil(math.log2(most)) + 1 if most > 1 else 1):
        # a text that had one name before this level is named already
        done.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        pairs = current.filter("n > 1").groupBy("row", "n", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(ALONE)).alias("b"),
        )
        pairs = scratch.table(pairs, f"pairs-{level}")
        names = _numbered(pairs, scratch, f"names-{level}", ["a", "b"])
        current = scratch.table(matched(pairs, names, ["a", "b"], "times", total, at).select("row", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "found.name"), f"named-{level}")
        scratch.drop(f"names-{level}", f"pairs-{level}")
    done.append(current.filter("n = 1").select("row", F.lit(level + 1).alias("level"), "name"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _grouped(rows: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, sha, keep_id, keep_row, group_size. Columns may come anew on each reading but row's order."""
    keyed = rows.select("row", "doc_id", lower_ascii(F.col("text")).cast("binary").alias("bytes")).select("*", F.length("bytes").alias("len"), F.xxhash64("bytes").alias("h"))
    every = scratch.table(keyed.select("row", "doc_id", "len", "h", F.sha2("bytes", 256).alias("sha")), "rows")
    shared = scratch.table(every.groupBy("len", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    total = every.count()
    alone = matched(every, shared, ["len", "h"], "c", total, F.xxhash64("row")).filter("found is null")
    alone = alone.select("row", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    n = F.greatest(F.lit(1), F.ceil(F.length("bytes") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    partners = matched(keyed, shared, ["len", "h"], "c", total, F.xxhash64("row")).filter("found is not null").withColumn("n", n)
    partners = partners.select("row", "doc_id", "n", F.sha2("bytes", 256).alias("sha"), F.posexplode(cut).alias("pos", "block"))
    blocks = scratch.table(partners.select("row", "n", "pos", "block", F.when(F.col("pos") == 0, F.struct("doc_id", "sha")).alias("of")), "blocks")
    named = scratch.table(block_identities(blocks.select("row", "n", "pos", "block"), scratch), "named")
    members = blocks.filter("pos = 0").select("row", "of.doc_id", "of.sha")
    members = scratch.table(members.join(named, "row"), "members")
    scratch.drop("blocks", "named", "names-0", *(f"named-{k}" for k in range(64)))
    # of rows with the largest id, the first stays; maxima are formed before the shuffle
    stays = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row")).alias("r")))
    groups = scratch.table(members.groupBy("level", "name").agg(stays.alias("s"), F.count(F.lit(1)).alias("group_size")), "groups")
    together = matched(members, groups, ["level", "name"], "group_size", total, F.xxhash64("row"))
    together = together.select("row", "doc_id", "sha", F.col("found.s.doc_id").alias("keep_id"), (-F.col("found.s.r")).alias("keep_row"), "found.group_size")
    return together.unionByName(alone)


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest
    doc_id stays. Null text counts as empty, and empty texts are equal. A null doc_id is smaller
    than any other. Rows that repeat both doc_id and text are counted in group_size, and exactly one
    of them stays if theirs is the largest id. Whole texts are compared, however long. An empty table
    gives an empty result; columns other than doc_id and text are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    found = _grouped(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), scratch, block_bytes)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id.

    Rows are written with a number each and go by number, so that null and repeated ids do not matter.
    Texts are equal as in ``exact_dedup``: null and empty texts are one group, of which a row stays; of
    rows that repeat in full one stays. Columns may have any names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact-copies")
    row_, gone_ = unused(docs.columns, "row", "gone")
    rows = scratch.table(docs.withColumn(row_, F.monotonically_increasing_id()), "numbered")
    found = _grouped(rows.select(F.col(row_).alias("row"), "doc_id", "text"), scratch, BLOCK_BYTES)
    gone = scratch.table(found.filter("row <> keep_row").select(F.col("row").alias(gone_)), "gone")
    return rows.join(small(gone, gone.count()), F.col(row_) == F.col(gone_), "left_anti").select(*docs.columns)
