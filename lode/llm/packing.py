"""Best-fit packing of tokenised documents by exact-complement hashing.

Lengths of pieces are at most the sequence size, so the whole packing problem is a histogram. For
each length, longest first, sums of one, two and three lengths that fill its gap exactly are looked
up and consumed as often as counts allow. What is left is packed by best fit, longest first. The driver
works on the histogram only; pieces get their places by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, small
from .tokens import Encoder, default_path, text_groups

SIZE = 2048
END_ID = 0
#: Plans leave pieces shorter than these shares of a sequence to best fit. From a third on no pair or triple is left, and best fit decides.
RESERVED = (0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 6, 0.2, 0.25, 0.28, 0.3, 0.32, 0.33, 1 / 3)
#: Pieces of one length that are ranked in one task, about.
RANKED = 500
#: Groups of pieces, besides one for each length, at most: their table stays small.
MOST_GROUPS = 190_000


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only what is over ``size`` is cut, the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Length counts -> (lengths of a sequence, number of such sequences), every piece used once.

    Pairs and triples fill gaps that singles cannot, but use up short pieces that best fit could put
    to better use. So plans are made that leave ever more of the shortest pieces to best fit; the first
    of those with the fewest sequences is taken, which is the one with the most lengths to combine. A
    plan at the lower bound, all tokens over the size, ends the search.
    """
    bound, best = -(-sum(length * n for length, n in counts.items()) // size), None
    for share in RESERVED:
        full, rest = complements(counts, size, max(1, round(size * share))), dict(counts)
        for lengths, n in full:
            for x in lengths:
                rest[x] -= n
        made = full + best_fit(rest, size)
        sequences = sum(n for _, n in made)
        if best is None or sequences < best[0]:
            best = sequences, made
        if sequences == bound:
            break
    return best[1]


def complements(counts: dict[int, int], size: int, least: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """Full sequences: for each length, longest first, sums of one, two and three lengths that fill its gap
    exactly, as often as counts allow. Pairs and triples take lengths of at least ``least`` only.
    """
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        """Consumes the combination as often as counts allow."""
        need = Counter(lengths)
        n = min(int(have[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                have[x] -= n * k
            out.append((lengths, n))

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available (a, b) with a >= b >= least and a + b = total, largest a first."""
        a = np.arange(min(most, total - least), (total - 1) // 2, -1)
        for x in a[(have[a] > 0) & (have[total - a] > 0)].tolist():
            yield x, total - x

    take(size)
    for length in range(size - 1, 0, -1):
        gap = size - length
        if have[length]:
            take(length, gap)
        if have[length]:
            for a, b in pairs(gap, length):
                take(length, a, b)
                if not have[length]:
                    break
        if have[length] and gap > 2:
            for a in [x for x in np.flatnonzero(have[: min(length, gap - 2) + 1])[::-1].tolist() if x >= least]:
                for b, c in pairs(gap - a, a):
                    take(length, a, b, c)
                    if not have[length] or not have[a]:
                        break
                if not have[length]:
                    break
    return out


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest piece first: each piece goes to the open sequence with the least gap that holds it.

    Sequences of equal contents are one entry with a number, so the time follows the distinct lengths
    and contents, not the pieces.
    """
    open_: dict[int, Counter] = {}  # gap -> contents -> number of sequences
    gaps = np.zeros(size + 1, bool)
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                contents, there = open_[gap].popitem()
            else:
                gap, contents, there = size, (), left
            times = min(left, gap // length)  # a sequence that took a piece has the least gap for the next, while that holds it
            n = min(there, left // times)
            if len(fits):
                if n < there:
                    open_[gap][contents] = there - n
                elif not open_[gap]:
                    gaps[gap] = False
            left -= n * times
            gap -= times * length
            open_.setdefault(gap, Counter())[contents + (length,) * times] += n
            gaps[gap] = True
    return [(contents, n) for by in open_.values() for contents, n in by.items()]


def _slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: (first rank, number per sequence, first sequence, first offset)."""
    rows, ranks, sequence = [], np.zeros(size + 1, np.int64), 0
    for lengths, n in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            rows.append((length, ranks[length], each, sequence, offset))
            ranks[length] += n * each
            offset += length * each
        sequence += n
    rows.sort()
    return dict(zip(("length", "rank", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in text_groups(b.column(1).to_pylist()):
                rows = []
                for i, data in enumerate(encoder.encode(texts)):
                    data += end
                    rows += [(ids[first + i], k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(data) // 4, size))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row per piece.

    Null text counts as empty and is a piece of the end id alone. Repeated rows are packed each, and
    null ids are ids like any other. Whole texts are packed, however long; columns other than doc_id
    and text are not read, whatever their names. An empty table gives an empty result. ``path`` is a
    tokenizers file that every executor can read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "packing")
    table = scratch.table(pieces(docs, path or default_path(), size, end_id), "pieces")
    # rows of a length are ranked in salted groups, each beginning where the one before ends; a length has a
    # group for every RANKED of its pieces, or more where that made over MOST_GROUPS, so that no group is hot
    counts = scratch.table(table.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "counts")  # at most ``size`` rows
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    per = max(RANKED, -(-sum(histogram.values()) // MOST_GROUPS))
    salts = counts.select("length", F.ceil(F.col("n") / F.lit(per)).alias("salts"))
    salted = table.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts").cast("int")).drop("salts")
    groups = scratch.table(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "groups")
    base = groups.withColumn("base", F.expr("sum(n) over (partition by length order by salt rows between unbounded preceding and current row) - n")).select("length", "salt", "base")
    ranked = salted.withColumn("r", F.expr("row_number() over (partition by length, salt order by doc_id, piece, ids_crc32)"))
    ranked = ranked.join(small(base, groups.count()), ["length", "salt"]).withColumn("rank", F.col("r") - 1 + F.col("base"))
    slots = _slots(plan(histogram, size), size)
    held = spark.sparkContext.broadcast(slots)  # bounded by the sequence size, not by the number of pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = held.value
        span = 1 << 44  # over any rank
        keys = slots["length"] * span + slots["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            past = rank - slots["rank"][at]
            each = slots["each"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(slots["sequence"][at] + past // each), pa.array(slots["offset"][at] + past % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
