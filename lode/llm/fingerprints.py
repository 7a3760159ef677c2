"""Document fingerprints: canonical exact digests, with byte comparison where digests are equal.

The canonical text is NFKC, case-folded, with white space folded to single blanks; the normaliser and
the case folding are those of the Unicode library that Spark itself ships, called in the JVM. The
digest is four chained 64-bit xxhashes. Canonical texts of one digest are compared as bytes by their
least and greatest; where these differ, each distinct text gets a number of its own. So fingerprints
are equal exactly if canonical texts are, and the likeness of two is 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

BITS = 256
#: Documents in an ordered bucket, about, as long as this makes no more than MOST_BUCKETS.
BUCKET_ROWS = 2_000
MOST_BUCKETS = 1 << 16
FAN = 256
#: Bytes of bucket heads up to which they are broadcast.
HEAD_BYTES = 8_000_000


def with_canonical(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds the canonical text. ASCII texts only need lower-casing."""
    ascii_ = F.octet_length(text) == F.length(text)
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(ascii_, F.lower(text)).otherwise(nfkc(fold(nfkc(F.col(text)))))
    return df.withColumn(to, folded).withColumn(to, F.trim(F.regexp_replace(to, "(?U)\\s+", " ")))


def digest(canon: Column, bits: int = BITS) -> Column:
    """Lowercase hex of ``bits`` bits."""
    wide = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), canon))), 16, "0") for k in range(4)])
    return F.substring(wide, 1, bits // 4)


def _bucket(docs: DataFrame, scratch: Scratch, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, h, ...) with a bucket that never falls in the order (doc_id, h), nulls first; and the
    buckets' first rows: bucket, f_id, f_h, before (the bucket before, for the first one the last).

    The keys alone are sorted by range, and each ``bucket_rows``-th begins a bucket: so equal ids, null
    ids and dense runs of ids are divided like any others, by the hashes of their texts. Buckets grow
    where they would be more than MOST_BUCKETS. A row finds its bucket in a tree of two levels, FAN wide.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "h")
    n = docs.count()
    every = max(bucket_rows, -(-n // MOST_BUCKETS))
    keys = docs.select(key.alias("k")).repartitionByRange("k").sortWithinPartitions("k").withColumn("at", F.monotonically_increasing_id())
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # rows that repeat in full begin one bucket at most
    cuts = scratch.table(keys.filter(place % every == 0).select("k").distinct(), "cuts")
    order = "over (order by k)"  # at most MOST_BUCKETS rows and one for each partition
    cuts = scratch.table(cuts.select("k", F.expr(f"row_number() {order} - 1").alias("bucket"), F.expr(f"lag(0, 1, 1) {order} = 1").alias("first")), "buckets")
    heads = [r["k"] for r in cuts.filter(F.col("bucket") % FAN == 0).orderBy("k").select("k").collect()]  # a FAN-th of them
    upper = F.array(*[F.struct(F.lit(k["known"]).alias("known"), F.lit(k["id"]).cast("long").alias("id"), F.lit(k["h"]).cast("long").alias("h")) for k in heads])
    branch = F.size(F.filter(upper, lambda c: c <= F.col("k"))) - 1 if heads else F.lit(0)
    leaves = cuts.groupBy(F.expr(f"bucket div {FAN}").cast("int").alias("branch")).agg(F.array_sort(F.collect_list("k")).alias("leaf"))  # FAN each
    rows = docs.withColumn("k", key).withColumn("branch", branch).join(F.broadcast(leaves), "branch")
    rows = rows.withColumn("bucket", F.col("branch") * FAN + F.size(F.filter("leaf", lambda c: c <= F.col("k"))) - 1).drop("k", "branch", "leaf")
    # the buckets that have rows: each partition's first key begins one, so all of them
    firsts = cuts.select("bucket", F.when(F.col("k.known"), F.col("k.id")).alias("f_id"), F.col("k.h").alias("f_h"))
    last = cuts.agg(F.max("bucket")).first()[0]
    return rows, firsts.withColumn("before", F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(F.lit(last)))


def _edited(text: Column, after: Column) -> Column:
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - k), after.substr(F.lit(1), k))


def fingerprint_edits(docs: DataFrame, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its last floor(n_chars / 4) code points replaced by the first as many
    of the next document's by ascending doc_id, or all there are; the first follows the last. Null text
    counts as empty. Null ids come first; rows of one doc_id stand in the order of a hash of their
    texts. A single document follows itself. Whole texts are read, however long; columns other than
    doc_id and text are not read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the first row of each bucket is what follows the last row of the bucket before
    keyed, firsts = _bucket(docs.withColumn("h", F.xxhash64("text")), scratch, bucket_rows)
    firsts = firsts.withColumnRenamed("bucket", "f_bucket")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    heads = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(firsts), same)  # MOST_BUCKETS rows of numbers at most
    heads = with_canonical(heads.select("before", "doc_id", "text", "h"), "text", "canon")
    heads = heads.select(F.col("before").alias("h_bucket"), F.col("doc_id").alias("head_id"), F.col("text").alias("head_text"), F.col("h").alias("head_h"), digest(F.col("canon"), bits).alias("head_fp"))
    heads = scratch.table(heads.dropDuplicates(["h_bucket"]), "heads")
    weight = heads.agg(F.sum(F.octet_length("head_text"))).first()[0] or 0

    rows = with_canonical(keyed, "text", "canon").withColumn("fp", digest(F.col("canon"), bits)).drop("canon")
    over = "(partition by bucket order by doc_id, h)"
    rows = rows.select("*", F.expr(f"lead(struct(doc_id, text, h, fp)) over {over}").alias("n"))
    rows = rows.join(F.broadcast(heads) if weight <= HEAD_BYTES else heads, rows.bucket == heads.h_bucket)
    last = F.col("n").isNull()
    pick = lambda name, head: F.when(last, F.col(head)).otherwise(F.col(f"n.{name}"))
    rows = rows.select("doc_id", "h", "text", "fp", pick("doc_id", "head_id").alias("next_id"), pick("h", "head_h").alias("next_h"), pick("fp", "head_fp").alias("next_fp"), pick("text", "head_text").alias("next_text"))
    rows = rows.withColumn("edited", _edited(F.col("text"), F.col("next_text")))
    rows = with_canonical(rows, "edited", "canon")
    found = scratch.table(
        rows.select("doc_id", "h", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", digest(F.col("canon"), bits).alias("efp")),
        "found",
    )
    found = _told_apart(docs.withColumn("h", F.xxhash64("text")), found, scratch, bits)
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), like("fp", "efp").alias("near_edited"), like("fp", "next_fp").alias("near_next"))


def _told_apart(docs: DataFrame, found: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """``found`` with fingerprints that no two different canonical texts share.

    Only texts whose digest another text has are read again and compared.
    """
    shared = found.select(F.explode(F.array("fp", "efp")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("d")
    # a text whose edited form has its own digest meets itself; such pairs are compared as well
    shared = scratch.table(shared, "shared")
    n_shared = shared.count()
    near = small(shared, n_shared)
    own = with_canonical(docs, "text", "canon").withColumn("d", digest(F.col("canon"), bits)).join(near, "d", "left_semi").select("doc_id", "h", "d", "canon")
    pairs = scratch.table(found.withColumn("d", F.col("efp")).join(near, "d", "left_semi").select("doc_id", "h", "next_id", "next_h").distinct(), "pairs")
    keys = pairs.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).union(pairs.select("next_id", "next_h")).distinct()
    n_keys = keys.count()
    texts = docs.join(small(keys, n_keys), docs.doc_id.eqNullSafe(keys.k_id) & (docs.h == keys.k_h), "left_semi").dropDuplicates(["doc_id", "h"])
    a, b = texts.alias("a"), texts.alias("b")
    edits = pairs.join(a, pairs.doc_id.eqNullSafe(F.col("a.doc_id")) & (pairs.h == F.col("a.h"))).join(b, pairs.next_id.eqNullSafe(F.col("b.doc_id")) & (pairs.next_h == F.col("b.h")))
    edits = edits.select(pairs.doc_id, pairs.h, "next_id", "next_h", _edited(F.col("a.text"), F.col("b.text")).alias("edited"))
    edits = with_canonical(edits, "edited", "canon").withColumn("d", digest(F.col("canon"), bits)).select("doc_id", "h", "next_id", "next_h", "d", "canon")
    both = own.select("d", "canon").unionByName(edits.select("d", "canon"))
    split = scratch.table(both.groupBy("d").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter("lo <> hi").select("d"), "collided")
    n_split = split.count()
    if not n_split:
        return found
    split = small(split, n_split)
    names = scratch.table(both.join(split, "d", "left_semi").distinct().withColumn("k", F.expr("dense_rank() over (partition by d order by canon)")), "names")
    mine = scratch.table(own.join(names, ["d", "canon"]).select(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"), F.col("k").alias("mk")).distinct(), "own-names")
    theirs = scratch.table(edits.join(names, ["d", "canon"]).select(F.col("doc_id").alias("e_id"), F.col("h").alias("e_h"), F.col("next_id").alias("e_next"), F.col("next_h").alias("e_next_h"), F.col("k").alias("ek")).distinct(), "edited-names")
    nxt = mine.select(F.col("m_id").alias("x_id"), F.col("m_h").alias("x_h"), F.col("mk").alias("xk"))
    out = found.join(mine, found.doc_id.eqNullSafe(mine.m_id) & (found.h == mine.m_h), "left")
    out = out.join(nxt, out.next_id.eqNullSafe(nxt.x_id) & (out.next_h == nxt.x_h), "left")
    out = out.join(theirs, out.doc_id.eqNullSafe(theirs.e_id) & (out.h == theirs.e_h) & out.next_id.eqNullSafe(theirs.e_next) & (out.next_h == theirs.e_next_h), "left")
    name = lambda d, k: F.when(F.col(k).isNull(), F.col(d)).otherwise(F.concat_ws("-", d, F.col(k).cast("string")))
    return out.withColumn("fp", name("fp", "mk")).withColumn("next_fp", name("next_fp", "xk")).withColumn("efp", name("efp", "ek"))
