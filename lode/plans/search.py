"""Retrieval queries: every benchmark item is a query over all documents, one document a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dot, highlight, html_escape, l2_normalise, token_estimate, tokenize
from ..operators import retrieval as R
from ..operators.chunking import chunk_documents
from ..scratch import Scratch
from .ingest import OFFSETS
from .registry import query, table

TOKENS = "list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> '')"
#: The chunk table: whole documents, or their chunks of sentences.
WHOLE = "(SELECT doc_id AS chunk_id, text, 0::INT AS start_char, length(text)::INT AS end_char FROM documents)"
DOCS = f"""
    d AS (SELECT chunk_id, text, start_char, end_char, {TOKENS.format("text")} AS toks FROM {WHOLE}),
    q AS (SELECT item_id AS query_id, text, {TOKENS.format("text")} AS toks FROM benchmark),
    p AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS token FROM d) GROUP BY chunk_id, token),
    qt AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(toks) AS token FROM q) GROUP BY query_id, token),
    df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
    st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_tokens FROM d)"""
BM25 = f"""{DOCS},
    raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
    idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    lens AS (SELECT chunk_id, len(toks) AS n_tokens FROM d),
    b0 AS (SELECT qt.query_id, p.chunk_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_tokens / avg_tokens))) AS bm25_raw
           FROM p JOIN qt ON p.token = qt.token JOIN idf ON idf.token = p.token JOIN lens ON lens.chunk_id = p.chunk_id, st GROUP BY qt.query_id, p.chunk_id),
    b AS (SELECT query_id, chunk_id, bm25_raw, round(bm25_raw / CASE WHEN max(bm25_raw) OVER (PARTITION BY query_id) > 0 THEN max(bm25_raw) OVER (PARTITION BY query_id) ELSE 1.0 END, 6) AS bm25 FROM b0)"""
VECTORS = """
    dv AS (SELECT chunk_id, ('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS k, sum(tf)::DOUBLE AS c FROM p GROUP BY 1, 2),
    qv AS (SELECT query_id, ('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS k, sum(qf)::DOUBLE AS c FROM qt GROUP BY 1, 2),
    dn AS (SELECT chunk_id, sqrt(sum(c * c)) AS norm FROM dv GROUP BY 1),
    qn AS (SELECT query_id, sqrt(sum(c * c)) AS norm FROM qv GROUP BY 1),
    sim AS (SELECT qv.query_id, dv.chunk_id, sum(qv.c * dv.c) AS s FROM dv JOIN qv ON dv.k = qv.k GROUP BY 1, 2),
    allv AS (SELECT q.query_id, d.chunk_id, round(coalesce(s, 0) / coalesce(qn.norm, 1) / coalesce(dn.norm, 1), 6) AS vector FROM q CROSS JOIN d LEFT JOIN sim ON sim.query_id = q.query_id AND sim.chunk_id = d.chunk_id
             LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN dn ON dn.chunk_id = d.chunk_id)"""
CANDIDATES = """
    v AS (SELECT query_id, chunk_id, vector FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, chunk_id) AS r FROM allv) WHERE r <= {candidates})"""
HYBRID = f"""{BM25}, {VECTORS}, {CANDIDATES.format(candidates=50)},
    h AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.chunk_id, v.chunk_id) AS chunk_id, coalesce(bm25, 0.0) AS bm25, coalesce(vector, 0.0) AS vector,
                 round(0.4 * coalesce(bm25, 0.0) + 0.6 * coalesce(vector, 0.0), 6) AS score
          FROM b FULL JOIN v ON b.query_id = v.query_id AND b.chunk_id = v.chunk_id),
    top AS (SELECT query_id, rank::INT AS rank, chunk_id, text, start_char, end_char, score, bm25, vector FROM (
        SELECT h.*, text, start_char, end_char, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, h.chunk_id DESC) AS rank FROM h JOIN d ON d.chunk_id = h.chunk_id WHERE score > 0) WHERE rank <= 5)"""
TRACE = f"""{BM25}, {VECTORS},
    t AS (SELECT allv.query_id, allv.chunk_id, coalesce(bm25, 0.0) AS bm25, vector, round(0.4 * coalesce(bm25, 0.0) + 0.6 * vector, 6) AS score
          FROM allv LEFT JOIN b ON b.query_id = allv.query_id AND b.chunk_id = allv.chunk_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit(0).alias("corpus"), F.col("doc_id").alias("chunk_id"), "text")


def index(spark: SparkSession, sf_dir: str) -> R.Index:
    return R.build_index(chunks(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"WITH {DOCS} SELECT token, df FROM df")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).document_frequency().select("token", "df")


@query(f"WITH {DOCS} SELECT token, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st")
def trace_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    return R.trace_idf(i.document_frequency(), i.stats()).select("token", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(bm25_raw, 6) AS bm25_raw FROM b")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(chunks(spark, sf_dir), items(spark, sf_dir)).select("query_id", "chunk_id", F.round("bm25_raw", 6).alias("bm25_raw"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, bm25 FROM b")
def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_normalised(R.bm25(chunks(spark, sf_dir), items(spark, sf_dir))).select("query_id", "chunk_id", "bm25")


LEXICAL_TOP = f"WITH {BM25} SELECT query_id, rank::INT AS rank, chunk_id, bm25 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id DESC) AS rank FROM b WHERE bm25 > 0) WHERE rank <= 5"


@query(LEXICAL_TOP)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.bm25_normalised(R.bm25(chunks(spark, sf_dir), items(spark, sf_dir))).withColumn("score", F.col("bm25")).filter("score > 0")
    return R.ranked(scores, R.TOP_K).select("query_id", "rank", "chunk_id", "score")


@query(LEXICAL_TOP)
def mode_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(chunks(spark, sf_dir), items(spark, sf_dir), R.Search(mode=R.LEXICAL)).select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {DOCS}, {VECTORS} SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT query_id, chunk_id, vector AS score, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, chunk_id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, chunk_id) AS r FROM allv) WHERE r <= 50 AND vector > 0) WHERE rank <= 5")
def mode_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(chunks(spark, sf_dir), items(spark, sf_dir), R.Search(mode=R.VECTOR)).select("query_id", "rank", "chunk_id", "score")


@query(f"WITH {HYBRID} SELECT query_id, rank, chunk_id, text, start_char, end_char, score, bm25, vector FROM top")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(chunks(spark, sf_dir), items(spark, sf_dir))


#: A document's chunks have its id and their number in one id.
NUMBERED = f"(WITH {OFFSETS} SELECT doc_id * 100000 + chunk_id AS chunk_id, text, start_char, end_char FROM oc)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of sentences of all documents, as one corpus."""
    c = chunk_documents(table(spark, sf_dir, "documents"), "By Sentence")
    return c.select(F.lit(0).alias("corpus"), (F.col("doc_id") * 100_000 + F.col("chunk_id")).alias("chunk_id"), "text", "start_char", "end_char")


@query(f"WITH {HYBRID} SELECT query_id, rank, chunk_id, text, start_char, end_char, score, bm25, vector FROM top".replace(WHOLE, NUMBERED))
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(passages(spark, sf_dir), items(spark, sf_dir))


@query(f"WITH {DOCS} SELECT p.chunk_id, p.token, p.tf, len(toks)::INT AS n_tokens FROM p JOIN d ON d.chunk_id = p.chunk_id".replace(WHOLE, NUMBERED))
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chunked, indexed and written; the postings of what is read back."""
    folder = Scratch(spark, "index").path("tables")
    R.build_index(passages(spark, sf_dir), folder)
    return R.open_index(spark, folder).postings().select("chunk_id", "token", "tf", "n_tokens")


@query(f"WITH {HYBRID} SELECT query_id, rank, chunk_id, score FROM top WHERE score >= 0.75")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(chunks(spark, sf_dir), items(spark, sf_dir), R.Search(score_threshold=0.75)).select("query_id", "rank", "chunk_id", "score")


NEAR = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id AS id, round(list_dot_product(q.e, embedding::DOUBLE[]), 6) AS score FROM q CROSS JOIN embeddings)"""


def near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every fiftieth vector is a query, over all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return R.knn(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, k)


@query(f"WITH {NEAR} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 10)


# 400 candidates: some have negative products, and rank below vectors that are no candidates and count 0
@query(f"WITH {NEAR} SELECT query_id, id, CASE WHEN r <= 400 THEN score ELSE 0.0 END AS score, (r <= 400) AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s)")
def knn_candidates_hybrid_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    every = R.all_scores(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v).select("query_id", "id")  # the stated queries
    found = near(spark, sf_dir, 400)
    return every.join(found, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNotNull().alias("candidate"))


@query(f"""WITH {NEAR}, c AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
    l AS (SELECT query_id, list(struct_pack(score := score, id := id, e := embedding::DOUBLE[]) ORDER BY score DESC, id DESC) AS hits FROM c JOIN embeddings ON vec_id = id WHERE r <= 50 AND score > 0 GROUP BY query_id),
    k AS (SELECT query_id, list_reduce(list_transform(hits, lambda h: [h]), lambda kept, h: CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda x: list_dot_product(x.e, h[1].e) >= 0.3)) > 0 THEN kept ELSE list_concat(kept, h) END) AS kept FROM l)
    SELECT query_id, i::INT AS rank, kept[i].id AS id, kept[i].score AS score FROM (SELECT query_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)""")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    hits = near(spark, sf_dir, 50).filter("score > 0").select("query_id", "id", "score").join(v, "id")
    return R.greedy_dedup(hits, 10, 0.3)


@query(f"WITH {TRACE} SELECT query_id, chunk_id, bm25, vector, score FROM t")
def trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace(chunks(spark, sf_dir), items(spark, sf_dir)).select("query_id", "chunk_id", "bm25", "vector", "score")


@query(f"WITH {TRACE} SELECT query_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rank FROM t) WHERE rank <= 5")
def trace_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace_top(R.trace(chunks(spark, sf_dir), items(spark, sf_dir)))


@query(f"WITH {DOCS}, m AS (SELECT q.query_id, d.chunk_id, list_filter(q.toks, lambda x: list_contains(d.toks, x)) AS m FROM q CROSS JOIN d) SELECT query_id, chunk_id, array_to_string(m, ' ') AS matched FROM m WHERE len(m) > 0")
def trace_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace_matches(chunks(spark, sf_dir), items(spark, sf_dir)).select("query_id", "chunk_id", F.array_join("matched", " ").alias("matched"))


@query(f"WITH {DOCS} SELECT query_id, token, round(coalesce(ln((n - df + 0.5) / (df + 0.5) + 1), 0.0), 6) AS idf FROM qt LEFT JOIN df USING (token), st")
def idf_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_idf(chunks(spark, sf_dir), items(spark, sf_dir))


WRAP = "CASE WHEN list_contains(m, regexp_replace(lower(w), '^[.,!?;:\"''()\\[\\]{{}}—-]+|[.,!?;:\"''()\\[\\]{{}}—-]+$', '', 'g')) THEN '<span style=\"background-color:#F9E79F;padding:1px 3px;border-radius:3px;font-weight:600\">' || w || '</span>' ELSE w END"


@query(f"""WITH {HYBRID}, m AS (SELECT top.*, list_filter(q.toks, lambda x: list_contains(d.toks, x)) AS m, list_filter(string_split_regex(top.text, '\\s+'), lambda x: x <> '') AS ws FROM top JOIN q ON q.query_id = top.query_id JOIN d ON d.chunk_id = top.chunk_id)
    SELECT query_id, rank, chunk_id, CASE WHEN len(m) = 0 THEN text ELSE array_to_string(list_transform(ws, lambda w: {WRAP.format()}), ' ') END AS marked FROM m""")
def trace_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = chunks(spark, sf_dir), items(spark, sf_dir)
    hits = R.search(c, q).select("query_id", "rank", "chunk_id", "text")
    found = hits.join(q.select("query_id", tokenize(F.col("text")).alias("q")), "query_id")
    matched = F.array_sort(F.array_intersect("q", tokenize(F.col("text"))))
    return found.select("query_id", "rank", "chunk_id", highlight(F.col("text"), matched).alias("marked"))


@query(f"WITH {HYBRID} SELECT query_id, chunk_id, round(bm25 / CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN max(bm25) OVER (PARTITION BY query_id) ELSE 1.0 END, 6) AS bm25_bar, vector AS vector_bar, score AS combined_bar FROM top")
def fusion_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.search(chunks(spark, sf_dir), items(spark, sf_dir))
    most = F.expr("max(bm25) over (partition by query_id)")
    return hits.select("query_id", "chunk_id", F.round(F.col("bm25") / F.when(most > 0, most).otherwise(1.0), 6).alias("bm25_bar"), F.col("vector").alias("vector_bar"), F.col("score").alias("combined_bar"))


@query(f"WITH {TRACE} SELECT query_id, least(29, greatest(0, floor(score * 30)))::INT AS bin, count(*) AS n FROM t GROUP BY 1, 2")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.trace(chunks(spark, sf_dir), items(spark, sf_dir))
    return t.groupBy("query_id", F.least(F.lit(29), F.greatest(F.lit(0), F.floor(F.col("score") * 30))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


METRICS = f"""WITH {HYBRID},
    pv AS (SELECT a.query_id, a.rank AS i, b.rank AS j, sum(x.c * y.c) / max(nx.norm) / max(ny.norm) AS s FROM top a JOIN top b ON a.query_id = b.query_id AND a.rank < b.rank
           JOIN dv x ON x.chunk_id = a.chunk_id JOIN dv y ON y.chunk_id = b.chunk_id AND x.k = y.k JOIN dn nx ON nx.chunk_id = a.chunk_id JOIN dn ny ON ny.chunk_id = b.chunk_id GROUP BY 1, 2, 3),
    red AS (SELECT query_id, avg(s) AS red FROM pv GROUP BY 1),
    cov AS (SELECT qt.query_id, count(*) FILTER (WHERE token IN (SELECT token FROM p JOIN top ON top.chunk_id = p.chunk_id WHERE top.query_id = qt.query_id)) / count(*) AS cov FROM qt GROUP BY 1),
    g AS (SELECT query_id, count(*) AS k, sum(length(text)) AS chars, var_pop(score) AS var, max(score) AS hi, min(score) AS lo, avg(score) AS mean, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM top GROUP BY 1)
    SELECT g.query_id, round(k / (SELECT count(*) FROM documents), 6) AS chunk_utilization, round(chars / (SELECT sum(length(text)) FROM documents), 6) AS char_coverage,
           round(CASE WHEN k > 1 THEN var ELSE 0.0 END, 6) AS score_variance, round(hi - lo, 6) AS score_spread, round(cov, 6) AS lexical_coverage, round(coalesce(red, 0.0), 6) AS redundancy,
           round(mean, 6) AS avg_score, round(hi, 6) AS top_score, round(CASE WHEN s2 > 0 THEN s1 / s2 ELSE 0.0 END, 6) AS score_dropoff
    FROM g LEFT JOIN red ON red.query_id = g.query_id LEFT JOIN cov ON cov.query_id = g.query_id"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = chunks(spark, sf_dir), items(spark, sf_dir)
    n = c.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    return R.eval_metrics(R.search(c, q), q, n["n"], n["chars"])


@query(METRICS)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


@query(f"SELECT query_id, redundancy FROM ({METRICS})")
def eval_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("query_id", "redundancy")


@query(f"SELECT query_id, lexical_coverage FROM ({METRICS})")
def eval_lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("query_id", "lexical_coverage")


@query(f"WITH {HYBRID} SELECT doc_id AS chunk_id, doc_id IN (SELECT chunk_id FROM top) AS matched FROM documents")
def match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    found = R.search(c, items(spark, sf_dir)).select("chunk_id").distinct().withColumn("m", F.lit(True))
    return c.select("chunk_id").join(found, "chunk_id", "left").select("chunk_id", F.coalesce("m", F.lit(False)).alias("matched"))


@query(f"WITH {HYBRID} SELECT query_id, min(chunk_id) AS first_match FROM top GROUP BY 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(chunks(spark, sf_dir), items(spark, sf_dir)).groupBy("query_id").agg(F.min("chunk_id").alias("first_match"))


PROMPT = f"""WITH {HYBRID}, g AS (SELECT query_id, string_agg('--- Chunk #' || chunk_id || ' (score: ' || printf('%.2f', score) || ') ---' || chr(10) || text, chr(10) ORDER BY rank) AS c FROM top GROUP BY 1)
    SELECT g.query_id, 'Use the following context to answer the question.' || chr(10) || chr(10) || 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || 'Answer:' AS prompt FROM g JOIN q ON q.query_id = g.query_id"""


@query(PROMPT)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prompts(R.search(chunks(spark, sf_dir), items(spark, sf_dir)), items(spark, sf_dir))


@query("SELECT doc_id, trunc(length(text) / 3.5)::INT AS tokens FROM documents")
def prompt_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm_before, 1.0::DOUBLE AS norm_after FROM embeddings")
def l2_normalise_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    n = l2_normalise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(e, e)), 6).alias("norm_before"), F.round(F.sqrt(dot(n, n)), 6).alias("norm_after"))


def _axis(name: str, start: str, squarings: int = 16) -> str:
    """CTEs: the first axis of the symmetric matrix ``start`` (i, j, v), by squaring it, as ``name`` (i, v)."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {start} WHERE i = j) AS v FROM {start})"]
    for k in range(squarings):
        steps.append(f"{name}{k}s AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY 1, 2)")
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}{k}s WHERE i = j) AS v FROM {name}{k}s)")
    last = f"{name}{squarings}"
    steps.append(f"{name}c AS (SELECT i, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))")
    steps.append(f"{name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM {name}c) AS v FROM {name}c)")
    return ", ".join(steps)


#: The covariance, its first axis, and the first axis of what that one leaves.
PCA = f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    z AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM e),
    cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2),
    {_axis("p", "cov")},
    size AS (SELECT sum(c.v * a.v * b.v) AS l FROM cov c JOIN p a ON a.i = c.i JOIN p b ON b.i = c.j),
    rest AS MATERIALIZED (SELECT c.i, c.j, c.v - l * a.v * b.v AS v FROM cov c JOIN p a ON a.i = c.i JOIN p b ON b.i = c.j, size),
    {_axis("q", "rest")}
    SELECT vec_id AS id, round(sum(z.x * p.v), 6) AS x, round(sum(z.x * q.v), 6) AS y FROM z JOIN p ON p.i = z.i JOIN q ON q.i = z.i GROUP BY 1"""


@query(PCA)
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = R.pca2(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return projected.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


VIEW = f"""WITH {HYBRID}, f AS (SELECT doc_id AS chunk_id, text, doc_id IN (SELECT chunk_id FROM top) AS matched FROM documents ORDER BY doc_id LIMIT 200)
    SELECT chunk_id, matched, (CASE WHEN matched THEN -1 ELSE chunk_id % 2 END)::INT AS colour,
           replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS body FROM f"""


@query(VIEW)
def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 chunks, the feature's own limit: escaped, with match flag and alternating colour."""
    c = chunks(spark, sf_dir)
    found = R.search(c, items(spark, sf_dir)).select("chunk_id").distinct().withColumn("m", F.lit(True))
    seen = c.orderBy("chunk_id").limit(200).join(found, "chunk_id", "left").withColumn("matched", F.coalesce("m", F.lit(False)))
    return seen.select("chunk_id", "matched", F.when(F.col("matched"), -1).otherwise(F.col("chunk_id") % 2).cast("int").alias("colour"), html_escape(F.col("text")).alias("body"))
