"""Lexical and vector retrieval over chunk tables: index statistics, scores, fusion, search, traces.

Chunks are rows (corpus, chunk_id, text, ...); a corpus is a document, or one constant for all. Queries
are rows (query_id, text). All statistics are per corpus, all rankings per query.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import dot, l2_normalise, tokenize
from ..scratch import Scratch

# Defaults of the search.
TOP_K, BM25_WEIGHT, VECTOR_WEIGHT, SCORE_THRESHOLD, CANDIDATES, DEDUP = 5, 0.4, 0.6, 0.0, 50, 1.0
HYBRID, VECTOR, LEXICAL = "Hybrid", "Vector (KNN)", "Lexical (BM25)"
K1, B, EPSILON = 1.5, 0.75, 0.25
DIM = 64
#: Queries whose vectors are sent to the executors at once; more are run in blocks.
MOST_QUERIES = 10_000
#: Queries that are scored against a batch at once; bounds the scores held.
TILE = 512
#: Rows up to which a table of numbers and tokens is broadcast, by its measured count.
BROADCAST_ROWS = 500_000


# --- index ---


@dataclass(frozen=True)
class Index:
    """A chunk table with what one reading of its texts gave.

    ``forward`` has a row per chunk: corpus, chunk_id, n_tokens, terms (array of token, tf), embedding.
    """

    chunks: DataFrame
    forward: DataFrame

    def postings(self) -> DataFrame:
        """corpus, chunk_id, token, tf, n_tokens."""
        return self.forward.select("corpus", "chunk_id", F.inline("terms"), "n_tokens")

    def stats(self) -> DataFrame:
        """corpus, n (chunks), avg_tokens."""
        return self.forward.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avg_tokens"))

    def document_frequency(self) -> DataFrame:
        """corpus, token, df."""
        return self.postings().groupBy("corpus", "token").agg(F.count(F.lit(1)).alias("df"))

    def vectors(self) -> DataFrame:
        """id, embedding."""
        return self.forward.select(F.col("chunk_id").alias("id"), "embedding")


def _forward(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """One pass over the texts, each tokenised once: counts of its tokens and the stand-in embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            vectors, tokens, tfs, ends, sizes = np.zeros((b.num_rows, dim)), [], [], [0], []
            for i, t in enumerate(b.column(2).to_pylist()):
                words = (t or "").lower().split()
                counts = Counter(words)
                tokens += counts.keys()
                tfs += counts.values()
                ends.append(len(tokens))
                sizes.append(len(words))
                v = bucket_counts(counts, cache, dim)
                vectors[i] = v / (np.linalg.norm(v) or 1.0)
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(tfs, pa.int64())], ["token", "tf"]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * (b.num_rows + 1), dim), pa.int32()), pa.array(vectors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), terms, flat], names=["corpus", "chunk_id", "n_tokens", "terms", "embedding"])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    return chunks.select("corpus", "chunk_id", "text").mapInArrow(run, f"corpus {kinds['corpus']}, chunk_id {kinds['chunk_id']}, n_tokens int, terms array<struct<token:string,tf:bigint>>, embedding array<double>")


def build_index(chunks: DataFrame | Index, folder: str | None = None) -> Index:
    """The index of a chunk table, written to ``folder`` or to the shared folder: all searches read it, none the texts."""
    if isinstance(chunks, Index):
        return chunks
    forward = _forward(chunks)
    if folder is None:
        return Index(chunks, Scratch(chunks.sparkSession, "index").table(forward, "forward"))
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    forward.write.mode("overwrite").parquet(f"{folder}/forward")
    return open_index(chunks.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/forward"))


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its measured number of rows is within the bound."""
    return F.broadcast(df) if rows <= most else df


def trace_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """corpus, token, idf: ln((n - df + 0.5) / (df + 0.5) + 1), the displayed one."""
    return df.join(small(stats, stats.count()), "corpus").select("corpus", "token", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def ranking_idf(df: DataFrame, stats: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """corpus, token, idf: ln(n - df + 0.5) - ln(df + 0.5); negative ones become a quarter of the mean over all terms.

    Of ``tokens`` (token) only, if given; the mean is over all terms none the less.
    """
    stats = small(stats, stats.count())
    raw = df.join(stats, "corpus").select("corpus", "token", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("corpus").agg(F.avg("raw").alias("mean"))
    if tokens is not None:
        raw = raw.join(tokens, "token", "left_semi")
    return raw.join(mean, "corpus").select("corpus", "token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token, qf."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qf"))


def bm25(chunks: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """query_id, corpus, chunk_id, bm25_raw of chunks that share a token with the query.

    Statistics are reduced to the queries' tokens and written, then joined to the postings where they
    stand, if their measured size allows. Common tokens are no hot keys: what is grouped is (query,
    chunk), all of whose postings one task has.
    """
    index = build_index(chunks)
    scratch = Scratch(queries.sparkSession, "bm25")
    qt = scratch.table(query_tokens(queries), "query-tokens")
    tokens = qt.select("token").distinct()
    stats = scratch.table(index.stats(), "stats")
    df = scratch.table(index.document_frequency(), "terms")
    idf = ranking_idf(df, stats, small(tokens, tokens.count()))
    weights = scratch.table(idf.join(stats, "corpus").join(qt, "token").select("corpus", "token", "query_id", (F.col("qf") * F.col("idf")).alias("w"), "avg_tokens"), "weights")
    hits = index.postings().join(small(weights, weights.count()), ["corpus", "token"])
    norm = K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("query_id", "corpus", "chunk_id").agg(F.sum(part).alias("bm25_raw"))


def bm25_normalised(scores: DataFrame) -> DataFrame:
    """Adds bm25: over the query's largest, or over 1 where that is not positive."""
    scores = Scratch(scores.sparkSession, "bm25-scores").table(scores, "scores")
    most = scores.groupBy("query_id").agg(F.max("bm25_raw").alias("_most"))
    return scores.join(small(most, most.count()), "query_id").withColumn("bm25", F.round(F.col("bm25_raw") / F.when(F.col("_most") > 0, F.col("_most")).otherwise(1.0), 6)).drop("_most")


# --- vectors ---


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """A deterministic stand-in for a model: token counts by hashed bucket, as a unit vector. Lexical, not semantic."""
    buckets = F.transform(tokenize(text), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("bigint") % dim).cast("int"))
    zeros = F.array_repeat(F.lit(0), dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)))
    return l2_normalise(F.when(F.size(buckets) == 0, zeros).otherwise(counts))


def bucket_counts(counts: dict[str, int], cache: dict[str, int], dim: int = DIM) -> np.ndarray:
    """Token counts by hashed bucket; ``cache`` keeps tokens' buckets."""
    ids = []
    for w in counts:
        k = cache.get(w)
        if k is None:
            if len(cache) > 500_000:
                cache.clear()
            k = cache[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dim
        ids.append(k)
    return np.bincount(np.array(ids, int), np.array(list(counts.values()), float), dim) if ids else np.zeros(dim)


def hashed_counts(text: str | None, cache: dict[str, int], dim: int = DIM) -> np.ndarray:
    """``bucket_counts`` of a text."""
    return bucket_counts(Counter((text or "").lower().split()), cache, dim)


def embed(rows: DataFrame, text: str = "text", to: str = "embedding", dim: int = DIM) -> DataFrame:
    """The stand-in for whole tables, over Arrow batches with a cache of token buckets."""
    fields = StructType([*rows.schema.fields, StructField(to, ArrayType(DoubleType()))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            out = np.zeros((b.num_rows, dim))
            for i, t in enumerate(b.column(at).to_pylist()):
                v = hashed_counts(t, cache, dim)
                out[i] = v / (np.linalg.norm(v) or 1.0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * (b.num_rows + 1), dim), pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=[*b.schema.names, to])

    return rows.mapInArrow(run, fields)


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, embedding) x (id, embedding) -> query_id, id, score, rank: the exact k best by inner product.

    The stated queries go to every task as one matrix; each task keeps its own k best per query, so
    what is shuffled is k rows per query and task, never a score of every pair. Ties go to smaller ids.
    Queries beyond MOST_QUERIES are run in blocks, each block's hits a written table.
    """
    queries, vectors = queries.select("query_id", "embedding"), vectors.filter("embedding is not null").select(F.col("id").cast("long"), "embedding")
    rows = queries.limit(MOST_QUERIES + 1).collect()
    if len(rows) <= MOST_QUERIES:
        return _best(_block_knn(rows, vectors, k)[0], k)
    scratch = Scratch(vectors.sparkSession, "knn")
    vectors, queries = scratch.table(vectors, "vectors"), scratch.table(queries, "queries")
    left, found = queries.toLocalIterator(), []
    while rows := list(itertools.islice(left, MOST_QUERIES)):
        hits, matrix = _block_knn(rows, vectors, k)
        found.append(scratch.table(_best(hits, k).drop("rank"), f"block-{len(found)}"))
        matrix.destroy()
    # a query_id that several rows have may stand in several blocks
    return _best(reduce(DataFrame.unionByName, found), k)


def all_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, id, score of every pair, unranked: a task sends each batch's scores on and keeps none.

    For traces, whose result is every pair. Queries beyond MOST_QUERIES are run in blocks.
    """
    left, found = queries.select("query_id", "embedding").toLocalIterator(), []
    while rows := list(itertools.islice(left, MOST_QUERIES)):
        names = [r["query_id"] for r in rows]
        matrix = vectors.sparkSession.sparkContext.broadcast(np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1))

        def run(batches: Iterator[pa.RecordBatch], names: list = names, matrix: Broadcast = matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for name, s in zip(names, np.round(matrix.value @ x.T, 6) if b.num_rows else (), strict=bool(b.num_rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name, np.int64)), pa.array(ids, pa.int64()), pa.array(s)], names=["query_id", "id", "score"])

        known = vectors.filter("embedding is not null").select(F.col("id").cast("long"), "embedding")
        found.append(known.mapInArrow(run, "query_id long, id long, score double"))
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id)")).filter(F.col("rank") <= k)


def _block_knn(rows: list, vectors: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """query_id, id, score of each task's k best for each of ``rows``; the matrix that was sent."""
    names = [r["query_id"] for r in rows]
    matrix = vectors.sparkSession.sparkContext.broadcast(np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1))

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.lexsort((ids, -scores))[:k]
        return ids[keep], scores[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = matrix.value
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(q), TILE):
                for i, s in enumerate(np.round(q[at : at + TILE] @ x.T, 6), at):
                    held[i] = best(np.concatenate([held[i][0], ids]), np.concatenate([held[i][1], s]))
        for name, (ids, s) in zip(names, held, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(s)], names=["query_id", "id", "score"])

    return vectors.mapInArrow(run, "query_id long, id long, score double"), matrix


# --- search ---


@dataclass(frozen=True)
class Search:
    """Parameters of a search; an unknown mode ranks by the lexical score, which it does not compute."""

    mode: str = HYBRID
    top_k: int = TOP_K
    bm25_weight: float = BM25_WEIGHT
    vector_weight: float = VECTOR_WEIGHT
    score_threshold: float = SCORE_THRESHOLD
    num_candidates: int = CANDIDATES
    dedup_threshold: float = DEDUP

    def combined(self) -> Column:
        if self.mode == HYBRID:
            return F.round(self.bm25_weight * F.col("bm25") + self.vector_weight * F.col("vector"), 6)
        return F.col("vector") if self.mode == VECTOR else F.col("bm25")


def scored(chunks: DataFrame | Index, queries: DataFrame, how: Search, all_vectors: bool = False) -> DataFrame:
    """query_id, chunk_id, bm25, vector, score of chunks that have either score.

    Only branches that the mode needs are planned. A chunk outside the candidates has vector score 0,
    not its inner product, unless ``all_vectors``. chunk_id is unique over the chunks.
    """
    index = build_index(chunks)
    none = queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, bm25 double, vector double")
    sides = []
    if how.mode in (HYBRID, LEXICAL) or all_vectors:
        sides.append(bm25_normalised(bm25(index, queries)).select("query_id", "chunk_id", "bm25", F.lit(0.0).alias("vector")))
    if how.mode in (HYBRID, VECTOR) or all_vectors:
        asked = embed(queries.select("query_id", "text"))
        near = all_scores(asked, index.vectors()) if all_vectors else knn(asked, index.vectors(), max(how.num_candidates, how.top_k))
        sides.append(near.select("query_id", F.col("id").alias("chunk_id"), F.lit(0.0).alias("bm25"), F.col("score").alias("vector")))
    both = none
    for s in sides:
        both = both.unionByName(s)
    # a union and a sum instead of an outer join: one shuffle, partial sums first
    return both.groupBy("query_id", "chunk_id").agg(F.sum("bm25").alias("bm25"), F.sum("vector").alias("vector")).withColumn("score", how.combined())


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """Adds rank by falling score, ties to larger chunk_id; the first k."""
    return scores.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, chunk_id desc)")).filter(F.col("rank") <= k)


def greedy_dedup(hits: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, score, embedding) -> query_id, rank, id, score: in score order, a hit goes if its
    inner product with one that stays reaches ``threshold``; stops at k. A fold over the query's hits,
    which must be bounded (candidates)."""
    item = F.struct(F.col("score"), F.col("id"), F.col("embedding"))
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("hits"))
    kind = "array<struct<score:double,id:bigint,embedding:array<double>>>"
    def step(kept: Column, h: Column) -> Column:
        like = F.exists(kept, lambda x: dot(x["embedding"], h["embedding"]) >= threshold)
        return F.when((F.size(kept) >= k) | like, kept).otherwise(F.concat(kept, F.array(h)))

    kept = F.aggregate(F.col("hits").cast(kind), F.array().cast(kind), step)
    return lists.select("query_id", F.posexplode(kept).alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("h.id").alias("id"), F.col("h.score").alias("score"))


RESULT = "query_id long, rank int, chunk_id long, text string, start_char int, end_char int, score double, bm25 double, vector double"


def _placed(chunks: DataFrame) -> DataFrame:
    """chunk_id, text and offsets; a chunk table without offsets has chunks that are whole texts."""
    if "start_char" in chunks.columns:
        return chunks.select("chunk_id", "text", "start_char", "end_char")
    return chunks.select("chunk_id", "text", F.lit(0).alias("start_char"), F.length("text").alias("end_char"))


def search(chunks: DataFrame | Index, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """The hits of each query, as columns RESULT.

    Scores that are not positive or below the threshold go; with ``dedup_threshold`` below 1 so do hits
    too like an earlier one. Texts are joined last, to hits only.
    """
    if how.top_k < 1:
        return queries.sparkSession.createDataFrame([], RESULT)
    index = build_index(chunks)
    hits = scored(index, queries, how).filter((F.col("score") > 0) & (F.col("score") >= how.score_threshold))
    if how.dedup_threshold < 1:
        vectors = index.vectors().withColumnRenamed("id", "chunk_id")
        kept = greedy_dedup(hits.join(vectors, "chunk_id").select("query_id", F.col("chunk_id").alias("id"), "score", "embedding"), how.top_k, how.dedup_threshold)
        top = kept.select("query_id", "rank", F.col("id").alias("chunk_id")).join(hits, ["query_id", "chunk_id"])
    else:
        top = ranked(hits, how.top_k)
    top = Scratch(queries.sparkSession, "search").table(top, "top")  # top_k rows a query
    found = _placed(index.chunks).join(small(top, top.count()), "chunk_id")
    return found.select("query_id", "rank", "chunk_id", "text", "start_char", "end_char", "score", "bm25", "vector")


# --- explain and evaluate ---


def trace(chunks: DataFrame | Index, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """query_id, chunk_id, bm25, vector, score over all chunks: no candidates, filters or dedup."""
    return scored(chunks, queries, how, all_vectors=True)


def trace_top(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, chunk_id, score: the first k of a trace, whatever their scores."""
    return ranked(scores, k).select("query_id", "rank", "chunk_id", "score")


def trace_matches(chunks: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, matched: the query's tokens that the chunk has, in query order, repeats kept."""
    q = queries.select("query_id", F.posexplode(tokenize(F.col("text"))).alias("p", "token"))
    have = build_index(chunks).postings().select("chunk_id", "token")
    hits = have.join(small(q, q.count()), "token").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("p", "token"))).alias("m"))
    return hits.select("query_id", "chunk_id", F.transform("m", lambda x: x["token"]).alias("matched"))


def query_idf(chunks: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """query_id, token, idf of the query's distinct tokens; 0 for one that no chunk has."""
    index = build_index(chunks)
    idf = trace_idf(index.document_frequency(), index.stats())
    return query_tokens(queries).join(idf, "token", "left").select("query_id", "token", F.round(F.coalesce("idf", F.lit(0.0)), 6).alias("idf"))


def eval_metrics(hits: DataFrame, queries: DataFrame, n_chunks: int, n_chars: int) -> DataFrame:
    """The nine metrics of each query with hits (query_id, rank, chunk_id, score, text)."""
    by = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.length("text")).alias("chars"), F.var_pop("score").alias("var"), F.max("score").alias("hi"), F.min("score").alias("lo"), F.avg("score").alias("mean"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.array_distinct(F.flatten(F.collect_list(F.array_distinct(tokenize(F.col("text")))))).alias("tokens"),
    )
    q = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("q"))
    v = embed(hits.select("query_id", "rank", "text")).select("query_id", "rank", "embedding")
    a, b = v.alias("a"), v.alias("b")  # at most top_k rows a query
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank"))).groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg(dot(F.col("a.embedding"), F.col("b.embedding"))).alias("red"))
    r = lambda c: F.round(c, 6)
    return by.join(q, "query_id").join(pairs, "query_id", "left").select(
        "query_id",
        r(F.col("k") / n_chunks).alias("chunk_utilization"),
        r(F.col("chars") / n_chars).alias("char_coverage"),
        r(F.when(F.col("k") > 1, F.col("var")).otherwise(0.0)).alias("score_variance"),
        r(F.col("hi") - F.col("lo")).alias("score_spread"),
        r(F.when(F.size("q") > 0, F.size(F.array_intersect("q", "tokens")) / F.size("q")).otherwise(0.0)).alias("lexical_coverage"),
        r(F.coalesce("red", F.lit(0.0))).alias("redundancy"),
        r(F.col("mean")).alias("avg_score"),
        r(F.col("hi")).alias("top_score"),
        r(F.when(F.col("s2") > 0, F.col("s1") / F.col("s2")).otherwise(0.0)).alias("score_dropoff"),
    )


# The prompt around the chunks.
CHUNK_HEAD = "--- Chunk #%d (score: %.2f) ---\n%s"
PROMPT = "Use the following context to answer the question.\n\nContext:\n%s\n\nQuestion: %s\nAnswer:"


def prompts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: the hits in rank order under a header each, and the question."""
    parts = hits.withColumn("_p", F.format_string(CHUNK_HEAD, "chunk_id", "score", "text")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_p"))).alias("_parts"))
    parts = parts.withColumn("_c", F.array_join(F.transform("_parts", lambda x: x["_p"]), "\n"))
    return parts.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").select("query_id", F.format_string(PROMPT, "_c", "_q").alias("prompt"))


def pca2(vectors: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(id, embedding) -> id, x, y: centred projection on the first two principal axes.

    An axis points to where its largest entry, in size, is positive. ``also`` (queries, say) is projected
    on the axes of ``vectors``. An empty table gives an empty result.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = vectors.select("embedding").first()
    if first is None:
        return vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    dim = len(first[0])
    mean = vectors.select(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(str(i)) for i in range(dim)]).first()

    def centred(v: DataFrame) -> DataFrame:
        return v.select("id", array_to_vector(F.zip_with(F.transform("embedding", lambda x: x.cast("double")), F.array(*[F.lit(m) for m in mean]), lambda a, b: a - b)).alias("v"))

    model = PCA(k=2, inputCol="v", outputCol="p").fit(centred(vectors))
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    out = model.transform(centred(vectors if also is None else also)).select("id", vector_to_array("p").alias("p"))
    return out.select("id", *[(F.get("p", F.lit(i)) * float(signs[i])).alias(n) for i, n in enumerate("xy")])
