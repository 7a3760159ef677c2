import re
import zlib
from collections import Counter

import numpy as np

from lode.llm.boosting import fit
from lode.llm.html_blocks import blocks
from lode.llm.html_extract import extract, main_texts, trained, trained_by
from lode.llm.html_pages import Maker
from lode.llm.licenses import BASE, COMMON, DRIFT, LEAST_VOTES, LEAST_WORDS, NOTICES, license_scan
from lode.llm.quality import NAMES, classify, statistics

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_base_phrases(spark, odd, empty):
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = license_scan(docs).collect()
        key = lambda x: str(x)
        assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=key) == sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=key)
        assert all(0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) for g in got)
    assert license_scan(empty).collect() == []


def test_notices_with_edits(spark):
    texts = [
        "foo bar Licensed under the Apache License, Version 2.0. tail",
        "x Released under the MIT License. y Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and all associated documentation files",
        "the of and to a in is it for with the license version of the software",
        "cc by general public license all rights reserved " * 3,
    ]
    got = {g.doc_id: g for g in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "apache-2.0" and got[0].spans[0].start == 2
    assert got[1].labels == "mit" and len(got[1].spans) == 2
    assert got[2].labels == "mit" and 0.7 <= got[2].score <= 1
    assert got[3].labels == ""
    assert got[4].n_base == 9 and got[4].first_word == 0 and got[4].last_word == 21


def test_notices_behind_partial_matches(spark):
    warranty = dict(NOTICES)["warranty"]
    texts = [
        "released under " * 30 + "released under the mit license",
        "the software " * 40 + warranty,
        "released under gpl, released under bsd, " * 6 + "then released under the mit license",
        "released under " * 500 + "nothing",
        "permission is hereby granted free of charge to " + "x y z " * 200 + "any person obtaining a copy of this software",
        f"{warranty} {warranty} x {warranty}",
    ]
    got = {g.doc_id: g for g in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "warranty", "mit", "", "", "warranty"]
    assert got[0].score == 1 and got[1].score == 1 and len(got[5].spans) == 3


def brute_notices(text):
    """Labels by trying every place of a text: bigrams on diagonals up to DRIFT apart, then the words they cover."""
    words, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)), set()
    for label, notice in NOTICES:
        t = notice.split()
        votes = {}
        for i in range(len(t) - 1):
            if not {t[i], t[i + 1]} <= COMMON:
                for p in range(len(words) - 1):
                    if words[p : p + 2] == t[i : i + 2]:
                        votes.setdefault(p - i, []).append((i, p))
        needed = sum(not {t[i], t[i + 1]} <= COMMON for i in range(len(t) - 1))
        for d in votes:
            near = [v for e, vs in votes.items() if d <= e <= d + DRIFT for v in vs]
            if len({i for i, _ in near}) >= LEAST_VOTES * needed:
                span = words[min(p for _, p in near) : min(max(p for _, p in near) + 2, d + len(t) + DRIFT)]
                if len(set(span) & set(t)) >= LEAST_WORDS * len(set(t)):
                    labels.add(label)
    return labels


def test_notices_against_brute_force(spark, odd):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(150):
        out = []
        for _ in range(rng.integers(1, 5)):
            words = NOTICES[rng.integers(len(NOTICES))][1].split()
            words = [w for w in words if rng.random() > 0.2]
            for _ in range(rng.integers(0, 6)):
                words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(["the", "software", "zzz", "license", "of"])))
            out += words[int(rng.integers(0, 4)) :]
        texts.append(" ".join(out))
    got = {g.doc_id: g for g in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: brute_notices(t) | set(filter(None, brute_base(t)[4].split(","))) for i, t in enumerate(texts)}
    assert {i: set(filter(None, g.labels.split(","))) for i, g in got.items()} == want
    assert 0.3 * len(texts) < sum(bool(w) for w in want.values()) < len(texts)


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    mark = {r.doc_id: r.quality for r in labels.collect()}
    got = classify(docs, labels).collect()
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([g.predicted == mark[g.doc_id] for g in held if g.doc_id in mark]) >= 0.98
    assert len(classify(odd, labels).collect()) == odd.count()
    assert {g.score for g in classify(odd, labels.limit(0)).collect()} == {0.5}
    assert classify(empty, labels).collect() == []


def test_statistics():
    for text in (None, "", " ", "\n\n", "a", "\ud800x", "word " * 300_000):
        v = statistics(text)
        assert v.shape == (len(NAMES),) and np.isfinite(v).all()


def brute_statistics(text):
    """The main measures, by plain loops over characters, words and lines."""
    import math
    from itertools import pairwise

    n, words, lines = len(text), text.split(), [x for x in text.splitlines() if x.strip()]
    share = lambda xs, f: sum(map(f, xs)) / len(xs)
    counts = Counter(text)
    return {
        "lower": share(text, str.islower), "digit": share(text, str.isnumeric), "runs": sum(a == b for a, b in pairwise(text)) / n,
        "entropy": -sum(k / n * math.log(k / n) for k in counts.values()), "word_mean": share(words, len), "unique": len(set(words)) / len(words),
        "top_word": max(Counter(words).values()) / len(words), "line_copies": 1 - len(set(lines)) / len(lines), "line_mean": share(lines, len), "short_lines": share(lines, lambda x: len(x) < 30),
    }


def test_statistics_against_loops(monkeypatch, sample):
    from lode.llm import quality

    monkeypatch.setattr(quality, "SLICE", 64)
    texts = [r.text for r in sample.limit(40).collect()] + ["абвгдежзийклмноп", "abcdefghijklmnop", "aa bb\n\naa bb\n中文中文字", "x" * 1000]
    for text in texts:
        got = dict(zip(NAMES, statistics(text), strict=True))
        for k, v in brute_statistics(text).items():
            assert abs(got[k] - v) < 1e-9, (k, text[:40])


def test_quality_with_repeated_ids(spark):
    """An id that many rows have is learned from once."""
    docs = spark.createDataFrame([(1, f"some words number {i}") for i in range(500)] + [(2, "other words."), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == 502 and all(0 <= g.score <= 1 for g in got)


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    f = fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        margin = f.base
        for t in range(len(f.value)):
            node = 0
            for _ in range(f.depth):
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.edge[t, node])
            margin += f.value[t, node - (1 << f.depth) + 1]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(f.score(x[:20]), [walk(r) for r in x[:20]])
    assert len(fit(x[:0], y[:0]).value) == 0 and len(fit(x[:5], np.ones(5)).value) == 0


def test_blocks():
    page = '<p>a <b>b</b>&amp; c<p>d<br>e<script>var x="<p>no</p>"</script> f<!-- <p>no</p> --><ul><li>g<li>h</ul><title>t</title> 1 < 2'
    assert [b.text for b in blocks(page)] == ["a b& c", "d", "e f", "g", "h", "1 < 2"]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == []
    assert [b.text for b in blocks("<p>x<!-- open")] == ["x"] and blocks("<script>never closed") == []
    assert len(blocks("<p>x</p>" * 20_000)) == 20_000


def test_unclosed_and_inline_elements():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<p>one</p><svg><p>two</p>") == ["one", "two"] and texts("<p>one</p><svg>x</svg><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><select><option>x</option><p>two</p>") == ["one", "x", "two"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p title='a>b'>x</p><p it's>y</p><p a=\"open>z</p>") == ["x", "y", "z"]
    assert texts("<head><meta x><body><p>a</p>") == ["a"] and texts("<p>a</b></i></div>b") == ["a", "b"]
    assert texts("<p>a <b>b <i>c</b> d</i> e</p>") == ["a b c d e"]


def test_scanner_is_linear():
    import time

    for page in ("<div>x" * 150_000, "<p a=\"" * 150_000, "<svg>" * 200_000, "<b>" * 200_000 + "</i>" * 200_000, "</div>" * 170_000, "<a '" * 200_000, "<!-- " * 200_000, "<p class='a b'>x<i>" * 50_000, "<a" + " " * 1_000_000 + "'"):
        t = time.process_time()
        blocks(page)
        assert time.process_time() - t < 4, page[:20]


def test_words_after_the_64th_count():
    from lode.llm.html_extract import vectors

    a, b = (vectors(blocks(f"<p>{'cookie ' * 64}{tail * 36}</p>"))[0] for tail in ("cookie ", "menu "))
    assert not np.array_equal(a, b)


def test_lstm_gradients():
    from lode.llm.html_extract import WIDTH, _lstm, _lstm_back

    rng = np.random.default_rng(0)
    x, live = rng.normal(size=(4, 3, WIDTH)), np.array([[1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], float)
    w, u, b = rng.normal(0, 0.1, (WIDTH, 8)), rng.normal(0, 0.5, (2, 8)), rng.normal(size=8)
    weight = rng.normal(size=(4, 3, 2))
    loss = lambda: float((_lstm(x, live, w, u, b) * weight).sum())
    kept = []
    _lstm(x, live, w, u, b, kept)
    got = _lstm_back(weight, x, u, kept)
    for p, g in zip((w, u, b), got, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            keep, step = p[at], 1e-2
            p[at] = keep + step
            high = loss()
            p[at] = keep - step
            low = loss()
            p[at] = keep
            assert abs((high - low) / (2 * step) - g[at]) < 2e-3 + 1e-2 * abs(g[at])


def test_extract_made_up_and_table_pages(spark):
    labeller = trained_by(spark)
    assert all(np.allclose(v, labeller.p[k], atol=1e-3) for k, v in trained().p.items())
    maker = Maker(4242)
    pages = [maker.page() for _ in range(150)]
    right = sum(t == "\n".join(x for x, y in truth if y) for t, (_, truth) in zip(main_texts([p for p, _ in pages], labeller), pages, strict=True))
    assert right >= 0.8 * len(pages)
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in table.collect()}
    import html as h

    def want(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = (re.sub(r"\s+", " ", h.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner))
        return "\n".join(x for x in parts if x)

    got = extract(table, labeller).collect()
    assert len(got) == len(html) and all(g.n_chars == len(g.text) for g in got)
    assert np.mean([g.text == want(html[g.page_id]) for g in got]) >= 0.99
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>" + "x " * 200_000, 3)], "page_id long, url string, html string, text int")
    assert len(extract(odd, labeller).collect()) == 3 and extract(table.limit(0), labeller).collect() == []
