"""Language identification by mixture inference.

Each learned language is a distribution over hashed character trigrams of words. A document is a
mixture of languages: its words are drawn from languages in unknown proportions, and a word's
likelihood is the product over its trigrams. Expectation-maximisation estimates the proportions;
starting from all languages, those that do not pay for themselves are removed while the penalised
likelihood rises. The language with the largest proportion in the set that remains is predicted.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, id_crc, small

BUCKETS = 1 << 15
#: Documents that a language is learned from, about: rows are chosen by a hash of their id.
SAMPLE_DOCS = 2_000
#: Languages up to which the model is a dense table; beyond, counts that are not zero are kept.
DENSE_LANGS = 256
EM_ROUNDS = 12
SMOOTHING = 0.5
#: Price of a language in the penalised likelihood, in units of log(words).
PENALTY = 2.0
HELD_OUT = 2
FOLDS = 4
_SLICE = 1_000_000
#: Cells of the model (trigrams times languages) that are looked up together.
CELLS = 4_000_000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() or unicodedata.category(chr(i))[0] == "M" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets, one for each letter with its neighbours in the word; where words begin."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[c]
    c = np.concatenate(([0], np.where(letter, c, 0), [0])).astype(np.uint64)
    at = np.flatnonzero(letter) + 1
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64), np.flatnonzero(c[at - 1] == 0)


def _slices(text: str) -> Iterator[str]:
    """The whole text in slices that end between words, so that long texts take bounded memory.

    A word is what the letter table holds for one, combining marks included.
    """
    at = 0
    while len(text) - at > _SLICE:
        till = at + _SLICE
        while till < len(text) and _letter_table()[ord(text[till])]:
            till += 1
        yield text[at:till]
        at = till
    yield text[at:]


class SparseTable:
    """log-probabilities by (bucket, language): what a bucket without counts has, and what counts add to it."""

    def __init__(self, bucket: np.ndarray, lang: np.ndarray, n: np.ndarray, buckets: int, langs: int):
        total = np.bincount(lang, n, langs) + SMOOTHING * buckets
        order = np.argsort(bucket, kind="stable")
        self.lang, self.base = lang[order].astype(np.int32), np.log(SMOOTHING / total).astype(np.float32)
        self.more = np.log1p(n[order] / SMOOTHING).astype(np.float32)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))

    def __getitem__(self, buckets: np.ndarray) -> np.ndarray:
        """Dense rows of the buckets asked for."""
        out = np.tile(self.base, (len(buckets), 1))
        for row, b in zip(out, buckets.tolist(), strict=True):
            at = slice(self.starts[b], self.starts[b + 1])
            row[self.lang[at]] += self.more[at]
        return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS) -> dict:
    """{"langs": [...], "logp": rows of langs by bucket} from text and non-null lang of the rows not held out.

    Every language is learned. About ``sample_docs`` whole documents of each, chosen by a hash of doc_id,
    are counted on the executors; the driver gets the counts that are not zero.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc(F.col("doc_id")) % FOLDS != HELD_OUT)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((buckets, 0), np.float32)}
    shares = spark.createDataFrame([(x, i, min(1.0, sample_docs / sizes[x])) for i, x in enumerate(langs)], "lang string, k int, share double")
    chosen = train.join(small(shares, len(langs)), "lang").filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for k, n in got.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["k", "bucket", "n"])
            got.clear()

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k not in got and len(got) >= DENSE_LANGS:
                    yield from counted()
                for part in _slices(text):
                    got[k] = got.get(k, 0) + np.bincount(_grams(part)[0], minlength=buckets)
        yield from counted()

    table = chosen.select("k", "text").mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    bucket, k, n = (table[c].to_numpy(int) for c in ("bucket", "k", "n"))
    if len(langs) > DENSE_LANGS:
        return {"langs": langs, "logp": SparseTable(bucket, k, n, buckets, len(langs))}
    counts = np.zeros((buckets, len(langs)))
    counts[bucket, k] = n
    counts += SMOOTHING
    return {"langs": langs, "logp": np.log(counts / counts.sum(0)).astype(np.float32)}


def _mixture(like: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of rows of (scaled) likelihoods."""
    pi = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        joint = like * pi
        joint /= joint.sum(1, keepdims=True)
        new = joint.mean(0)
        if np.abs(new - pi).max() < 1e-4:
            pi = new
            break
        pi = new
    return pi, float(np.log(like @ pi).sum())


def infer(text: str | None, model: dict) -> tuple[str, float, int]:
    """Predicted language, its proportion in the document, and the number of languages in the set.

    ``und`` with score 0 for null text, text without a letter, or a model without languages.
    """
    langs, logp = model["langs"], model["logp"]
    if not text or not langs:
        return "und", 0.0, 0
    rows = []
    for part in _slices(text):
        gram, begins = _grams(part)
        # so many words at a time that the rows of their trigrams take bounded memory; a word may be long
        most = max(1, CELLS // len(langs))
        ends, at = np.append(begins[1:], len(gram)), 0
        while at < len(begins):
            till = max(at + 1, int(np.searchsorted(ends, begins[at] + most, side="right")))
            own = gram[begins[at] : ends[till - 1]]
            if till == at + 1:
                rows.append(sum(logp[own[k : k + most]].sum(0, keepdims=True, dtype=np.float32) for k in range(0, len(own), most)))
            else:
                rows.append(np.add.reduceat(logp[own], begins[at:till] - begins[at], axis=0, dtype=np.float32))
            at = till
    if not rows:
        return "und", 0.0, 0
    ll = np.concatenate(rows)
    like = np.maximum(np.exp(ll - ll.max(1, keepdims=True)), 1e-6)
    keep = list(range(len(langs)))
    price = PENALTY * np.log(len(like) + 1)
    pi, best = _mixture(like)
    best -= price * len(keep)
    while len(keep) > 1:
        # the least language goes if the likelihood it adds is below its price
        order = [k for i, k in enumerate(keep) if i != int(np.argmin(pi))]
        new_pi, new = _mixture(like[:, order])
        new -= price * len(order)
        if new < best:
            break
        keep, pi, best = order, new_pi, new
    top = int(np.argmax(pi))
    return langs[keep[top]], float(min(1.0, pi[top])), len(keep)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, lang_pred, score, n_langs: one row per input row, ids as they come."""
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # dense or sparse by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            got = [infer(t.as_py(), model) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32())], names=["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs for each row of (doc_id, text, lang, ...).

    held_out rows (crc32 of doc_id as text, mod 4, is 2) are never learned from; a null id counts as
    empty text there. Null text or text without a letter is ``und`` with score 0. Repeated rows get
    equal predictions; an empty table gives an empty result. Whole texts are read, however long;
    columns other than doc_id, text and lang are not read, whatever their names.
    """
    out = predict(docs, learn(docs, sample_docs))
    return out.select("doc_id", (id_crc(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score", "n_langs")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, in however many languages.

    The text is scored in place, so that rows need not be joined back by id: null and repeated ids do
    not matter, repeated rows stay or go together, and columns may have any names. Rows with null text
    or without a letter go. An empty table stays empty.
    """
    model = learn(docs)
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [infer(t.as_py(), held.value) for t in b.column(at)]
            yield b.filter(pa.array([g[0] != "und" for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
