import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lode.llm.common import Scratch
from lode.llm.fingerprints import fingerprint_edits
from lode.llm.token_files import decode_values, encode_block, encode_values, read_blocks, read_tokens, token_index, write_tokens
from lode.llm.tokens import Encoder, default_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_values_round_trip(values):
    control, data = encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert decode_values(control, data, len(values)).tolist() == values


def test_block_round_trip():
    docs = [[5, 5, 70_000], [], [2], [5, 9] * 1000]
    content = b"".join(encode_block(ids, [np.array(d, "<u4").tobytes() for d in docs]) + b"\0" for ids in ([1, None, 3, 4], [7, 8, 9, -1]))
    got = list(read_blocks(content))
    assert [g[0] for g in got] == [[1, None, 3, 4], [7, 8, 9, -1]]
    for _, lengths, ids in got:
        assert lengths.tolist() == [len(d) for d in docs] and ids.tolist() == sum(docs, [])
    with pytest.raises(ValueError):
        list(read_blocks(content[:60] + b"x" + content[61:]))


@pytest.mark.parametrize("table", ["odd", "sample"])
@pytest.mark.parametrize("sizes", [(300, 2), (1 << 18, 24)])
def test_index(request, table, sizes):
    docs = request.getfixturevalue(table)
    e = Encoder.at(default_path()).tokenizer
    rows = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    want, at = [], 0
    for r in rows:
        ids = e.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(g) for g in token_index(docs, block_ids=sizes[0], file_blocks=sizes[1]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_files_hold_all_ids(spark, sample, empty):
    scratch = Scratch(spark, "test")
    write_tokens(sample, scratch.path("f"))
    e = Encoder.at(default_path()).tokenizer
    want = {r.doc_id: e.encode(r.text, add_special_tokens=False).ids + [2] for r in sample.collect()}
    assert {r.doc_id: r.ids for r in read_tokens(spark, scratch.path("f"), True).collect()} == want
    assert token_index(empty).collect() == []


def canonical(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"[\s\x1c-\x1f]+", " ", nfkc(nfkc(text).casefold())).strip(" ")


@pytest.mark.parametrize("bits", [256, 8])
@pytest.mark.parametrize("bucket_rows", [1, 2000])
@pytest.mark.parametrize("table", ["odd", "sample"])
def test_fingerprints(request, table, bits, bucket_rows):
    """At 8 bits most digests collide, and the byte comparison has to tell the texts apart."""
    docs = request.getfixturevalue(table).filter("doc_id is null or doc_id <> 8").drop("sha", "name")
    rows = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    got = {r.doc_id: r for r in fingerprint_edits(docs, bits, bucket_rows).collect()}
    assert len(got) == len(rows)
    own, edited = {}, {}
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, nxt = r.text or "", after.text or ""
        k = len(text) // 4
        e = text[: len(text) - k] + nxt[:k]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        own[r.doc_id], edited[r.doc_id] = canonical(text), canonical(e)
        assert g.near_edited == float(canonical(text) == canonical(e)) and g.near_next == float(canonical(text) == canonical(nxt))
    pairs = {(own[i], g.fingerprint) for i, g in got.items()} | {(edited[i], g.edited_fingerprint) for i, g in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_repeated_rows_and_empty(odd, empty):
    got = fingerprint_edits(odd).collect()
    assert len(got) == odd.count()
    assert sum(g.near_next for g in got if g.doc_id == 8) >= 1
    assert fingerprint_edits(empty).collect() == []


@pytest.mark.parametrize("fan,rows", [(256, 1), (2, 1), (3, 2)])
def test_null_and_equal_ids_are_divided(spark, monkeypatch, fan, rows):
    """The order of all rows against one sort, with ids that most rows share."""
    from lode.llm import fingerprints

    monkeypatch.setattr(fingerprints, "FAN", fan)
    ids = [None] * 9 + [5] * 9 + [-7, 0, 6, 6]
    docs = spark.createDataFrame([(i, f"text number {k} " * (k % 3 + 1)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    got = fingerprint_edits(docs, bucket_rows=rows).collect()
    assert len(got) == len(ids)
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    order = [r.text for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    want = []
    for text, after in zip(order, [*order[1:], order[0]], strict=True):
        k = len(text) // 4
        want.append(hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest())
    assert sorted(g.edited_sha256 for g in got) == sorted(want)


def test_before_in_two_levels(spark):
    from lode.llm.token_files import _before

    rows = [(p, c, 1 + (7 * p + c) % 5) for p in range(23) for c in range(p % 3 + 1)]
    files = spark.createDataFrame(rows, "part int, chunk int, n long")
    want, at = {}, 0
    for p, c, n in sorted(rows):
        want[p, c] = at
        at += n
    for parts in (1, 4, 1024):
        assert {(r.part, r.chunk): r.before for r in _before(files, parts).collect()} == want


@pytest.fixture(scope="module")
def fresh():
    """The tokenizer as its file says, without a setting changed."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_ids_of_a_whole_table(spark, fresh):
    """Every text of a table, and each again with odd white space, marks and special tokens put in."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(9)
    odd = ["  ", "\n\n", " \n", "\t", "\u00a0", "\u2003", "\u3000", "\r\n", "\0", "<|endoftext|>", " 's", "'ll", "...", "é", "中", "\U0001f600", "\u0301", "1234567", "_", "\x1c", "\x85", "\u200b"]
    changed = []
    for t in texts:
        cut = sorted(rng.integers(0, len(t) + 1, 6).tolist())
        parts = [t[a:b] for a, b in zip([0, *cut], [*cut, len(t)], strict=True)]
        changed.append("".join(p + (odd[rng.integers(len(odd))] if i < 6 else "") for i, p in enumerate(parts)))
    for group in (texts, changed):
        want = [e.ids for e in fresh.encode_batch(group, add_special_tokens=False)]
        got = Encoder.at(default_path()).encode(group)
        assert [i for i, (g, w) in enumerate(zip(got, want, strict=True)) if np.frombuffer(g, "<u4").tolist() != w] == []


@settings(max_examples=1000, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(fresh, text):
    assert np.frombuffer(Encoder.at(default_path()).encode([text])[0], "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts():
    """Against a tokenizer as loaded."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "plain, text. here", "", "x<|endoftext|>\n\n y", "<|endof text|>"]
    got = Encoder.at(default_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(got[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_memory_of_an_encoder_is_bounded():
    """Words that never come again, long ones and many in one text, take no more than the bound."""
    import tracemalloc

    e = Encoder(default_path())
    tracemalloc.start()
    try:
        e.encode([" ".join(f"{i}{'q' * 2_000}" for i in range(20_000))])
        e.encode([f"{i}{'q' * 2_000}" for i in range(20_000, 40_000)])
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 130 << 20


def test_ids_with_a_small_cache(fresh, monkeypatch):
    """Entries that go inside a text are learned again."""
    from lode.llm import tokens

    monkeypatch.setattr(tokens, "CUT_BYTES", 20_000)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 10_000)
    texts = [" ".join(f"word{i * k % 601}, it's \u00e4pfel{i % 7}" for i in range(900)) for k in (1, 7, 13)] + ["x" * 50_000]
    got = tokens.Encoder(default_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_numbers_of_files(spark, tmp_path):
    """The name that a writer gives may have -c and a digit before its end."""
    block = encode_block([1, 2], [np.array([5, 2], "<u4").tobytes()] * 2) + b"\0"
    for c in (0, 2):
        (tmp_path / f"part-00003-c1bbcc5c-c123-4fd2-a120-c1856f01620f-c{c:03}.txt").write_bytes(block)
    assert sorted((r.part, r.chunk, r.place) for r in read_tokens(spark, f"file://{tmp_path}").collect()) == [(3, c, k) for c in (0, 2) for k in (0, 1)]
