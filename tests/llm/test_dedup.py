import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lode.llm.exact_dedup import drop_exact_copies, exact_dedup
from lode.llm.near_dedup import Covering, bucket_links, drop_near_copies, near_dedup, simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(FOLD), []).append(r.doc_id)
    key = lambda x: -1 if x is None else x
    return {t: (max(ids, key=key), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("table", ["odd", "sample"])
def test_exact(request, table, block):
    docs = request.getfixturevalue(table)
    rows, want = docs.collect(), None
    want = brute_exact(rows)
    if block == 7:
        docs = docs.filter("length(text) < 20000 or text is null")
        rows = docs.collect()
        want = brute_exact(rows)
    got = exact_dedup(docs, block).collect()
    assert len(got) == len(rows)
    expected = sorted((str(r.doc_id), str(want[t][0]), want[t][1], hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [(r.text or "").translate(FOLD)])
    assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.text_sha256) for g in got) == expected
    assert sum(g.kept for g in got) == len(want)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


def test_matched_finds_all_keys(spark):
    """Hot keys by broadcast and the others by a join, each row of a left table once, with null keys and keys that have no match."""
    from collections import Counter

    from lode.llm.common import matched

    keys = [(1, "a")] * 300 + [(1, "b")] * 40 + [(k, "c") for k in range(60)] + [(None, "a"), (7, None)]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "row long, k long, s string").repartition(5)
    number = Counter(k for k in keys if None not in k and k[0] % 3 != 2)
    table = spark.createDataFrame([(*k, n, f"{k[0]}{k[1]}") for k, n in number.items()], "k long, s string, n long, value string")
    for most in (1, 3, 1000):
        for spread in (F.col("row"), F.monotonically_increasing_id()):
            got = matched(rows, table, ["k", "s"], "n", len(keys), spread, most).select("row", "k", "s", "found.value").collect()
            assert sorted(got) == [(i, *k, f"{k[0]}{k[1]}" if k in number else None) for i, k in enumerate(keys)], most


def test_without_small_tables(sample, monkeypatch):
    """The same results where no table is small enough to be broadcast whole."""
    import lode.llm.common as common

    results = [exact_dedup, near_dedup, drop_exact_copies, drop_near_copies]
    want = [sorted(map(str, f(sample).collect())) for f in results]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert [sorted(map(str, f(sample).collect())) for f in results] == want


def test_exact_drop(odd, empty):
    rows = odd.collect()
    left = drop_exact_copies(odd)
    assert left.columns == odd.columns
    assert sorted((r.text or "").translate(FOLD) for r in left.collect()) == sorted(brute_exact(rows))
    assert exact_dedup(empty).collect() == [] and drop_exact_copies(empty).collect() == []


def test_names_do_not_depend_on_partitions(spark, sample):
    """Blocks are numbered by their place in one sorted order."""
    from lode.llm.common import Scratch
    from lode.llm.exact_dedup import _numbered

    values = sorted({(r.text or "")[:40] for r in sample.collect()}, key=lambda v: v.encode())
    found = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        keys = sample.selectExpr("substring(coalesce(text, ''), 1, 40) as b")
        for by in (None, [F.substring("b", 1, 4), F.xxhash64("b")]):
            found.append({r.b: r.name for r in _numbered(keys, Scratch(spark, "test"), "n", ["b"], by).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[2] == {v: i for i, v in enumerate(values)}
    assert found[1] == found[3] and sorted(found[1].values()) == list(range(len(values)))


def brute_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{doc index: component} by breadth first search over all pairs."""
    u = np.array(fps, np.uint64)
    comp = [-1] * len(u)
    for i in range(len(u)):
        if comp[i] < 0:
            todo = [i]
            comp[i] = i
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(np.bitwise_count(u ^ u[j]) <= 4):
                    if comp[k] < 0:
                        comp[k] = i
                        todo.append(int(k))
    return comp


@pytest.mark.parametrize("few", [0, 4_000_000])
@pytest.mark.parametrize("table", ["odd", "sample"])
def test_near(request, table, few):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    fps = [brute_simhash(r.text) for r in rows]
    comp = brute_components(fps)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        least[c] = min([x for x in (least.get(c), r.doc_id) if x is not None], default=None)
    got = near_dedup(docs, few=few).collect()
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == sorted((str(r.doc_id), f"{f:016x}", str(least[c])) for r, f, c in zip(rows, fps, comp, strict=True))


def test_near_empty(empty):
    assert near_dedup(empty).collect() == [] and drop_near_copies(empty).collect() == []


def test_near_drop_decides_by_row(spark, odd):
    """Repeated and null ids: a row stays or goes by its own text; one row of each component stays."""
    text = [" ".join(f"{w}{i}" for i in range(300)) for w in "abc"]
    near = text[0] + " tail"
    assert 0 < (simhash(text[0]) ^ simhash(near)).bit_count() <= 4
    rows = [(3, text[0]), (7, near), (7, text[1]), (None, near + " x"), (None, text[2])]
    left = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in (rows[0], rows[2], rows[4]))

    rows = odd.collect()
    comp = brute_components([brute_simhash(r.text) for r in rows])
    left = drop_near_copies(odd)
    assert left.columns == odd.columns
    least = {}
    for r, c in zip(rows, comp, strict=True):
        least[c] = min([x for x in (least.get(c), r.doc_id) if x is not None], default=None)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, least.values()))


def test_near_dense_group_in_chunks(spark):
    """Chains and balls of fingerprints, with buckets dealt into chunks, against all pairs."""
    from lode.llm.common import Scratch
    from lode.llm.components import components
    from lode.llm.near_dedup import near_links

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:10]:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    comp = brute_components(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    points = spark.createDataFrame([(s,) for s in signed], "fp long")
    for few, chunk in ((10**6, 20_000), (10**6, 8), (0, 20_000)):
        scratch = Scratch(spark, "test")
        roots = {r.u: r.root for r in components(scratch.table(near_links(points, len(fps), scratch, chunk, few), "e"), scratch).collect()}
        root = [roots.get(s, s) for s in signed]
        assert len(set(zip(root, comp, strict=True))) == len(set(root)) == len(set(comp))


def test_covering_meets_every_close_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(400):
        for bit in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1 << int(bit))
    for cover in (Covering(3, 1), Covering(5, 2)):
        met = np.zeros(400, bool)
        homes, visits = [set() for _ in x], [set() for _ in x]
        for at, key, home in cover.homes_and_visits(x):
            for i, k in zip(at, key, strict=True):
                homes[i].add(k) if home else None
        for at, key, _ in cover.homes_and_visits(y):
            for i, k in zip(at, key, strict=True):
                visits[i].add(k)
        met = [bool(h & v) for h, v in zip(homes, visits, strict=True)]
        assert all(met)


def test_bucket_links_long_bucket():
    rng = np.random.default_rng(2)
    fp = np.concatenate([rng.integers(0, 1 << 62, 300), 77 ^ (1 << rng.integers(0, 60, 50))]).astype(np.int64)
    visit = np.sort(rng.integers(0, 2, len(fp)).astype(np.int8))
    u, v = bucket_links(np.zeros(len(fp), np.int64), fp, visit)
    homes = {int(f) for f, w in zip(fp, visit, strict=True) if w == 0 and (f ^ 77).bit_count() == 1}
    if homes:
        assert {int(x) for x in fp if (int(x) ^ 77).bit_count() <= 1} <= {*map(int, u), *map(int, v)}


def test_simhash_brute():
    for text in (None, "", "a", "a b c d", "A b C d e", "x " * 70_000 + "y z", "é ü x ß"):
        assert simhash(text) == brute_simhash(text)
