import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lode.llm import langid
from lode.llm.langid import SparseTable, identify, infer, keep_identified, learn


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([g.lang_pred == lang[g.doc_id] for g in held]) >= 0.97


def test_mixture_sets(sample):
    model = learn(sample)
    by = {}
    for r in sample.collect():
        by.setdefault(r.lang, []).append(r.text)
    en, fr = " ".join(by["en"][:5])[:6000], " ".join(by["fr"][:5])[:3000]
    lang, score, n = infer(en + "\n" + fr, model)
    assert lang == "en" and 0.5 < score < 0.85 and n >= 2
    assert infer(en, model)[2] == 1
    assert infer(None, model) == infer("", model) == infer(" 12 !? ", model) == ("und", 0.0, 0)


def test_odd(odd, empty):
    got = identify(odd).collect()
    assert len(got) == odd.count() and all(0 <= g.score <= 1 for g in got)
    assert Counter(g.lang_pred for g in got)["und"] == 3
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and all(r.text and r.text.strip() for r in kept.collect())
    assert identify(empty).collect() == [] and keep_identified(empty).collect() == []


def test_every_language_is_learned(spark):
    """More languages than the dense table holds, the last ones with a document each."""
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, i = [], 0
    for k in range(300):
        words = ["".join(rng.choice(list(letters), 7)) for _ in range(8)]
        for _ in range(2 if k < 256 else 1):
            while zlib.crc32(str(i).encode()) % 4 == 2:
                i += 1
            rows.append((i, " ".join(words), f"l{k:03}"))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(docs)
    assert model["langs"] == [f"l{k:03}" for k in range(300)]
    assert [infer(r[1], model)[0] for r in rows[-44:]] == [r[2] for r in rows[-44:]]


def test_sparse_table_equals_dense():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 3, (50, 7))
    at = np.nonzero(counts)
    dense = np.log((counts + 0.5) / (counts + 0.5).sum(0))
    table = SparseTable(*at, counts[at], 50, 7)
    assert np.allclose(table[np.array([3, 49, 0, 3])], dense[[3, 49, 0, 3]], atol=1e-5)


def test_document_in_three_languages_is_kept(sample):
    by = {}
    for r in sample.collect():
        by.setdefault(r.lang, []).append(r.text)
    words = [" ".join(by[x]).split()[:n] for x, n in zip(sorted(by), (220, 180, 170), strict=False)]
    text = " ".join(sum(words, []))
    lang, score, n = infer(text, learn(sample))
    assert lang != "und" and score < 0.5 and n == 3
    mixed = sample.limit(1).withColumn("text", F.lit(text)).withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long"))
    assert -1 in {r.doc_id for r in keep_identified(sample.unionByName(mixed)).collect()}


def brute_infer(text, model, rounds=12, price=2.0):
    """The mixture by plain loops: likelihoods of words, EM, backward elimination."""
    import math
    import unicodedata

    letter = lambda c: c.isalpha() or unicodedata.category(c)[0] == "M"
    words = "".join(c if letter(c) else " " for c in text.lower()).split(" ")
    words = [w for w in words if w]
    ll = []
    for w in words:
        grams, _ = langid._grams(w)
        assert len(grams) == len(w)
        ll.append([sum(float(model["logp"][g][k]) for g in grams) for k in range(len(model["langs"]))])
    like = [[max(math.exp(x - max(row)), 1e-6) for x in row] for row in ll]

    def em(keep):
        pi = {k: 1 / len(keep) for k in keep}
        for _ in range(rounds):
            new = dict.fromkeys(keep, 0.0)
            for row in like:
                total = sum(row[k] * pi[k] for k in keep)
                for k in keep:
                    new[k] += row[k] * pi[k] / total / len(like)
            done = max(abs(new[k] - pi[k]) for k in keep) < 1e-4
            pi = new
            if done:
                break
        return pi, sum(math.log(sum(row[k] * pi[k] for k in keep)) for row in like) - price * math.log(len(like) + 1) * len(keep)

    keep = list(range(len(model["langs"])))
    pi, best = em(keep)
    while len(keep) > 1:
        less = [k for k in keep if k != min(keep, key=pi.get)]
        new_pi, new = em(less)
        if new < best:
            break
        keep, pi, best = less, new_pi, new
    top = max(keep, key=pi.get)
    return model["langs"][top], pi[top], len(keep)


def test_inference_against_brute_force(sample, monkeypatch):
    model = learn(sample)
    texts = [r.text[:1500] for r in sample.limit(25).collect()]
    texts += [texts[0][:300] + " " + texts[3][:300] + " " + texts[7][:200], "e\u0301le\u0300ve noe\u0308l " * 30]
    for slice_, cells in ((1_000_000, 4_000_000), (7, 40)):
        monkeypatch.setattr(langid, "_SLICE", slice_)
        monkeypatch.setattr(langid, "CELLS", cells)
        for t in texts:
            got, want = infer(t, model), brute_infer(t, model)
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-3 and got[2] == want[2]
