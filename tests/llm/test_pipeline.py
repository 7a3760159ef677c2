import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lode.llm.langid import infer, learn
from lode.llm.mixing import capped_targets
from lode.llm.packing import cut
from lode.llm.tokens import Encoder, default_path

from .test_dedup import FOLD, brute_components, brute_simhash
from .test_mixing_packing import words


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage, on all that its predecessor kept, against a plain version of it."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs_in, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        kept[name] = len(rows)
        if name == "language_id":
            model = learn(docs_in)
            want = {r.doc_id for r in before if infer(r.text, model)[0] != "und"}
            assert {r.doc_id for r in rows} == want and len(want) > 0.95 * len(before)
        elif name == "exact_dedup":
            last = {}
            for r in before:
                t = r.text.translate(FOLD)
                last[t] = max(last.get(t, -1), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(last.values())
        elif name == "near_dedup":
            least = {}
            for r, c in zip(before, brute_components([brute_simhash(r.text) for r in before]), strict=True):
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        elif name == "mix_sources":
            size, taken = Counter(), Counter()
            for r in before:
                size[r.source] += len(words(r.text))
            for r in rows:
                taken[r.source] += len(words(r.text))
            names = sorted(size, key=lambda s: (s is None, s or ""))
            for s, t in zip(names, capped_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
                assert abs(taken[s] - t) <= 2 + 0.002 * t
        else:
            e = Encoder.at(default_path()).tokenizer
            want = []
            for r in before:
                ids = e.encode(r.text or "", add_special_tokens=False).ids + [0]
                want += [(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cut(len(ids)))]
            assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
        if name != "pack_sequences":
            assert docs.columns == columns
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.count() == kept["pack_sequences"]


@pytest.mark.parametrize("table", ["odd", "named", "empty"])
def test_stages_on_odd_documents(request, spark, tmp_path, table):
    """Nulls, repeats, long texts and clashing names through every stage, against plain versions of what stays."""
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        texts = lambda rs: Counter((r.doc_id, r.text) for r in rs)
        if name == "language_id":
            assert texts(rows) == texts(r for r in before if any(c.isalpha() for c in r.text or ""))
        elif name == "exact_dedup":
            best = {}
            for r in before:
                t = r.text.translate(FOLD)
                best[t] = max(best.get(t, -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted(best.values()) == sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
        elif name == "near_dedup":
            assert len(rows) == len(set(brute_components([brute_simhash(r.text) for r in before])))
            assert not texts(rows) - texts(before)
        elif name == "mix_sources":
            assert {(r.doc_id, r.source) for r in rows} <= {(r.doc_id, r.source) for r in before}
        assert name == "pack_sequences" or docs.columns == columns
        assert bool(rows) == (table != "empty")


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_run_on_odd_and_empty_tables(request, spark, tmp_path, table):
    request.getfixturevalue(table).write.parquet(f"{tmp_path}/documents.parquet")
    assert bool(corpus_pipeline.run(spark, str(tmp_path)).collect()) == (table == "odd")
