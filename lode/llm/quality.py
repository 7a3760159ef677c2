"""Quality classifier: boosted trees over statistics of whole documents."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import arrow_batches, id_crc

#: Labelled rows that the trees are fitted on, about; chosen by a hash of their id.
SAMPLE_ROWS = 20_000
HELD_OUT = 0
FOLDS = 5
THRESHOLD = 0.3
#: Code points of a text that are counted together.
SLICE = 1 << 20
KINDS = ("lower", "upper", "letter", "digit", "blank", "newline", "ending", "joiner", "bracket", "symbol", "control")
NAMES = [
    *KINDS, "log_chars", "log_words", "word_mean", "word_sd", "word_max", "unique", "top_word", "short_words", "upper_words", "mixed_words", "log_lines", "line_mean", "line_sd", "line_max",
    "line_copies", "ended_lines", "bullet_lines", "short_lines", "runs", "entropy", "rare_letter", "sentence_words",
]
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Kind of each code point, by its Unicode category."""
    global _kinds
    if _kinds is None:
        of = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 5, "Zp": 5, "Ps": 8, "Pe": 8, "Pi": 8, "Pf": 8, "Pd": 7, "Pc": 7}
        table = np.empty(sys.maxunicode + 1, np.uint8)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))
            table[i] = of.get(c, {"L": 2, "M": 2, "P": 9, "S": 9}.get(c[0], 10))
        for chars, kind in (("\n\r\x0b\x0c", 5), ("\t", 4), (".!?:;,", 6), ("'\"", 7)):
            for ch in chars:
                table[ord(ch)] = kind
        _kinds = table
    return _kinds


def statistics(text: str | None) -> np.ndarray:
    """The feature vector of a whole text; all zeros but for logs where there is nothing to measure."""
    out = dict.fromkeys(NAMES, 0.0)
    text = text or ""
    if text:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.zeros(len(KINDS))
        runs, chars = 0, Counter()
        for at in range(0, len(c), SLICE):  # long texts in bounded memory
            part = c[at : at + SLICE]
            counts += np.bincount(_kind_table()[part], minlength=len(KINDS))
            runs += int((part[1:] == part[:-1]).sum()) + (at > 0 and part[0] == c[at - 1])
            if part.max() < 8192:  # a table of counts, else a sort: a single high code point would make the table large
                seen = np.bincount(part)
                points = np.flatnonzero(seen)
                chars.update(dict(zip(points.tolist(), seen[points].tolist(), strict=True)))
            else:
                chars.update(dict(zip(*(x.tolist() for x in np.unique(part, return_counts=True)), strict=True)))
        out |= dict(zip(KINDS, counts / len(c), strict=True))
        n = np.array(list(chars.values()), float)
        out |= {"log_chars": math.log1p(len(c)), "runs": runs / len(c), "entropy": float(-(n / n.sum() * np.log(n / n.sum())).sum())}
        words = text.split()
        if words:
            lens = np.fromiter(map(len, words), float, len(words))
            seen = Counter(words)
            out |= {
                "log_words": math.log1p(len(words)), "word_mean": lens.mean(), "word_sd": lens.std(), "word_max": math.log1p(lens.max()), "unique": len(seen) / len(words), "top_word": max(seen.values()) / len(words),
                "short_words": float((lens <= 3).mean()), "upper_words": sum(map(str.isupper, words)) / len(words), "mixed_words": 1 - sum(map(str.isalpha, words)) / len(words),
                "sentence_words": sum(w[-1] in ".!?" for w in words) / len(words), "rare_letter": sum(k for w, k in seen.items() if k == 1) / len(words),
            }
            lines = [x for x in text.splitlines() if x.strip()]
            ll = np.fromiter(map(len, lines), float, len(lines))
            out |= {
                "log_lines": math.log1p(len(lines)), "line_mean": ll.mean(), "line_sd": ll.std(), "line_max": math.log1p(ll.max()), "line_copies": 1 - len(set(lines)) / len(lines),
                "ended_lines": sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines), "bullet_lines": sum(x.lstrip()[0] in "-*•|#>" for x in lines) / len(lines), "short_lines": float((ll < 30).mean()),
            }
    return np.array([out[k] for k in NAMES])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees from labelled documents that are not held out.

    About ``sample_rows`` labels are used, chosen by a hash of doc_id; a doc_id with several labels has
    their mean, rounded, and one with several texts is learned from one of them, the one of the least
    hash. The chosen ids and their statistics are what the driver gets: they are bounded by
    ``sample_rows``, not by the table, however often an id is repeated.
    """
    arrow_batches(docs.sparkSession)
    marked = labels.filter("doc_id is not null and quality is not null").filter(id_crc(F.col("doc_id")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    share = min(1.0, sample_rows / max(1, marked.count()))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()).tolist() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # about sample_rows rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    rows = one.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(measure, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, score: one row per input row."""
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text, ...).

    held_out rows (crc32 of doc_id as text, mod 5, is 0) are never learned from; a null id counts as
    empty text there. Null text counts as empty and is scored like any other. Without labels every
    score is one half. Repeated rows get equal scores; an empty table gives an empty result. Whole texts
    are measured, however long; columns other than doc_id and text are not read, whatever their names.
    """
    out = score(docs, learn(docs, labels, sample_rows))
    return out.select("doc_id", (id_crc(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
