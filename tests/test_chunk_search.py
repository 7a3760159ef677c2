import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lode.operators import chunking as C
from lode.operators import limits as L
from lode.operators import messages as M
from lode.operators import retrieval as R


def chunks_of(spark, text, method="By Sentence", size=20, overlap=6):
    rows = C.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), method, size, overlap).orderBy("chunk_id").collect()
    return [r.text for r in rows], [(r.start_char, r.end_char) for r in rows]


def test_sentence_packing(spark):
    assert chunks_of(spark, "Aa bb. Cc dd. Ee. Ff gg hh. Ii.")[0] == ["Aa bb. Cc dd. Ee.", "Ee. Ff gg hh. Ii."]
    assert len(chunks_of(spark, "One very long sentence that exceeds. Ok.")[0][0]) > 20
    assert chunks_of(spark, "")[0] == []


def test_offsets(spark):
    text = "Alpha beta.\nGamma delta. Alpha beta."
    got = spark.createDataFrame([(text, ["Alpha beta. Gamma delta.", "Alpha beta."])], "t string, c array<string>").select(C.with_offsets(F.col("t"), F.col("c")).alias("o")).first()["o"]
    assert [(o.start_char, o.end_char) for o in got] == [(0, 24), (25, 36)]


def test_recursive_chunks_cover_and_fit():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(20)) + " " + "x" * 90
    got = C.split_recursive(text, 60, 10)
    assert all(0 < len(c) <= 60 for c in got)
    assert set(text.split()) - set(" ".join(got).split()) <= {"x" * 90}
    assert C.split_recursive("a\n\n\nb", 4, 0) == ["a", "b"] and C.split_recursive("a\n\n\n\n\nb", 3, 0) == ["a", "b"]
    assert C.split_recursive("short") == ["short"] and C.split_recursive("   ") == []


def test_headers():
    text = "# A\nintro\n\n## B\ntext one\n\ntext two\n```\n# no\n```\n# C\nlast"
    assert C.header_sections(text)[0] == (((1, "A"),), "intro")
    got = C.split_headers(text, 400, 50)
    assert got[0] == "# A\n\nintro" and got[1].startswith("# A\n## B\n\ntext one") and "# no" in got[1] and got[2] == "# C\n\nlast"


@pytest.mark.parametrize("size,overlap", [(100, 100), (0, 0), (10, -1)])
def test_validation(size, overlap):
    with pytest.raises(ValueError):
        C.validate(size, overlap)


def small(spark):
    c = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a b", "a c c", "d"])], "corpus int, chunk_id long, text string")
    q = spark.createDataFrame([(0, "c"), (1, "a b"), (2, "a a"), (3, "zzz")], "query_id long, text string")
    return c, q


def test_bm25_goldens(spark):
    c, q = small(spark)
    got = {(r.query_id, r.chunk_id): round(r.bm25_raw, 6) for r in R.bm25(c, q).collect()}
    assert got == {(0, 1): 0.628708, (1, 0): 0.574679, (1, 1): 0.052125, (2, 0): 0.127706, (2, 1): 0.10425}
    idf = {r.token: round(r.idf, 6) for r in R.trace_idf(R.build_index(c).document_frequency(), R.build_index(c).stats()).collect()}
    assert idf["a"] == round(math.log(1.5 / 2.5 + 1), 6) and idf["d"] == 0.980829


def test_search_modes_and_dedup(spark):
    c, q = small(spark)
    hits = R.search(c, q, R.Search(top_k=2)).collect()
    assert {h.query_id for h in hits} == {0, 1, 2} and all(h.score > 0 for h in hits)
    assert R.search(c, q, R.Search(mode="unknown")).collect() == []
    assert R.search(c, q, R.Search(top_k=0)).collect() == []
    twice = c.unionByName(c.withColumn("chunk_id", F.col("chunk_id") + 10))
    kept = R.search(twice, q, R.Search(dedup_threshold=0.95)).collect()
    for query in {h.query_id for h in kept}:
        texts = [h.text for h in kept if h.query_id == query]
        assert len(texts) == len(set(texts))


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(5)
    got = R.knn(v.filter("id < 4").withColumnRenamed("id", "query_id"), v, 7).collect()
    for qid in range(4):
        s = np.round(x @ x[qid], 6)
        assert [r.id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])] == sorted(range(300), key=lambda i: (-s[i], i))[:7]


def test_hashed_embeddings_agree(spark):
    rows = spark.createDataFrame([(1, "a b b c"), (2, ""), (3, None)], "chunk_id long, text string")
    got = R.embed(rows).withColumn("native", R.hashed_embedding(F.col("text"))).collect()
    for r in got:
        assert np.allclose(r.embedding, r.native)


def test_metrics(spark):
    hits = spark.createDataFrame([(0, 1, 0, 0.9, "a b"), (0, 2, 1, 0.6, "c"), (0, 3, 2, 0.3, "a")], "query_id long, rank int, chunk_id long, score double, text string")
    q = spark.createDataFrame([(0, "a z")], "query_id long, text string")
    r = R.eval_metrics(hits, q, 6, 10).first()
    assert (r.chunk_utilization, r.char_coverage, r.score_variance, r.score_spread, r.lexical_coverage, r.avg_score, r.top_score, r.score_dropoff) == (0.5, 0.5, 0.06, 0.6, 0.5, 0.6, 0.9, 1.5)


def test_limiter_and_changes(spark):
    got = spark.createDataFrame([([0, 1, 2, 10, 11, 12],)], "t array<bigint>").select(L.accepted(F.col("t"), 2, 10).alias("k")).first()["k"]
    assert (got.n, got["last"], got.live) == (4, 11, [10, 11])
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("AABA")], "k int, i int, c string")
    assert [r.changed for r in L.changed(rows, "k", "i", "c").orderBy("i").collect()] == [True, False, True, True]


def test_messages(spark):
    blocks = [("text", "hi", None), ("image_url", None, "data:image/png;base64,AA"), ("image_url", None, "data:image/svg+xml;base64,AA"), ("image_url", None, "http://x/y"), ("audio", None, None)]
    df = spark.createDataFrame([(blocks,)], f"b {M.BLOCKS}")
    got = df.select(M.translate_blocks(F.col("b")).alias("o"), M.first_text(M.translate_blocks(F.col("b"))).alias("t")).first()
    assert [(x.type, x.source) for x in got.o] == [("text", None), ("image", "base64"), ("image", "url")] and got.t == "hi"


def test_semantic_chunks_of_documents(spark):
    from lode.functions.text import sentences
    from lode.plans.ingest import chunk_compare_all

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    one = spark.createDataFrame([(-1, " one sentence only. "), (-2, "  "), (-3, None), (-4, "a b. a b. c d. c d."), (-4, "x y. x y. z.")], "doc_id long, text string")
    got = C.chunk_documents(one, "Semantic").collect()
    assert sorted((r.doc_id, r.chunk_id, r.text) for r in got) == [(-4, 0, "a b. a b."), (-4, 0, "x y. x y."), (-4, 1, "c d. c d."), (-4, 1, "z."), (-1, 0, " one sentence only. ")]
    parts = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    want = C.semantic_groups(R.embed(parts, "sentence"), "doc_id", "pos", "sentence", "embedding", 0.3)
    several = docs.filter(F.size(sentences(F.col("text"))) > 1)
    got = C.chunk_documents(several, "Semantic", threshold=0.3).select("doc_id", "chunk_id", "text")
    assert 0 < got.exceptAll(want).count() + got.count() == want.join(several, "doc_id", "left_semi").count()
    assert {r.method for r in chunk_compare_all(spark, "/root/testdata/sf0.001").collect()} == set(C.METHODS)


def test_knn_runs_queries_in_blocks(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id < 11").withColumnRenamed("id", "query_id")
    q = q.unionByName(q.filter("query_id = 2"))
    want = R.knn(q, v, 4).collect()
    monkeypatch.setattr(R, "MOST_QUERIES", 4)
    got = R.knn(q, v, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.query_id for r in got}) == 11


def test_projection_keeps_sides_and_takes_queries(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [5, 2, 1, 0.5] + 3
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = {r.id: (r.x, r.y) for r in R.pca2(v).collect()}
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    assert np.allclose([got[i] for i in range(60)], centred @ axes)
    asked = R.pca2(v, v.filter("id = 3")).collect()
    assert len(asked) == 1 and np.allclose((asked[0].x, asked[0].y), got[3])
    assert R.pca2(v.limit(0)).collect() == []


def test_trace_has_every_pair(spark, monkeypatch):
    c, q = small(spark)
    want = sorted(map(str, R.trace(c, q).collect()))
    assert len(want) == 12 and [r["rank"] for r in R.trace_top(R.trace(c, q), 2).filter("query_id = 3").orderBy("rank").collect()] == [1, 2]
    monkeypatch.setattr(R, "MOST_QUERIES", 3)
    assert sorted(map(str, R.trace(c, q).collect())) == want


def test_native_sentence_fold_equals_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect()
    from lode.functions.text import sentences

    rows = spark.createDataFrame([(r.text,) for r in docs], "t string").select("t", sentences(F.col("t")).alias("s")).collect()
    assert all(r.s == C.split_sentences(r.t) for r in rows)


def test_limiter_over_pauses(spark):
    """Histories cut at pauses against one loop over each."""
    rng = np.random.default_rng(1)
    rows = [(int(u), int(t)) for u in range(5) for t in np.cumsum(rng.choice([0, 1, 2, 3, 30], 200))]
    got = {r.u: (r.n_events, r.n_accepted, r.s) for r in L.rate_limit(spark.createDataFrame(rows, "u long, t long").selectExpr("u", "timestamp_seconds(t) as ts"), "u", "ts", 3, 10).selectExpr("*", "unix_seconds(last_accepted) as s").collect()}
    for u in range(5):
        kept = []
        for t in sorted(t for v, t in rows if v == u):
            if sum(t - k < 10 for k in kept) < 3:
                kept.append(t)
        assert got[u] == (200, len(kept), kept[-1])
