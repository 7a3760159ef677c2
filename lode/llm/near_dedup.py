"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into segments; a projection is a choice of segments. By pigeonhole two
fingerprints at 4 bits or fewer are, on some projection, at ``slack`` bits or fewer. On a projection
the anchors are the words of a covering code: a perfect Hamming(15, 11) code on its first 15 bits and
every value of its other bits, so that each point has its home anchor within the covering radius 1.
A point is sent to its home anchor and to every anchor within radius + slack; two points within
``slack`` then meet at the home anchor of either one. Homes are compared with all that came to their
anchor, by exact Hamming distance.

Exact copies share a fingerprint and are one point, so copies cost nothing. A bucket emits a
spanning set of links, not its pairs. A bucket with over ``chunk`` points is dealt into chunks that
meet pair by pair, which bounds what one group holds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, UPPER, Scratch, arrow_batches, matched, small, unused
from .components import STEPS, components

BITS = 64
MOST_BITS = 4
SHINGLE = 4
SEED = 42
CHUNK = 20_000
#: Up to so many distinct fingerprints three projections of about 21 bits; beyond, ten of about 26.
#: Both find the same links: the second makes more rows and far smaller buckets.
FEW_POINTS = 4_000_000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text: per bit, 1 if set in over half of the shingle hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        till = min(n, at + 65_536)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:till].tolist(), (ends[at + size - 1 : till + size - 1] - 1).tolist(), strict=True)), np.uint64, till - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])


class Covering:
    """Projections, anchors and neighbours for fingerprints at ``most_bits`` or fewer."""

    def __init__(self, segments: int, chosen: int, most_bits: int = MOST_BITS):
        cuts = [BITS * i // segments for i in range(segments + 1)]
        self.projections = [np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in c]) for c in itertools.combinations(range(segments), chosen)]
        self.slack = most_bits * chosen // segments
        if self.slack > 1 or len(self.projections) > 16:
            raise ValueError("the neighbour search covers a slack of one bit at most")
        # Hamming(15, 11): the syndrome of a word is the XOR of the positions (1 to 15) of its ones.
        word = np.arange(1 << 15, dtype=np.uint32)
        self.syndrome = np.zeros(1 << 15, np.int64)
        for i in range(15):
            self.syndrome ^= np.where(word >> i & 1, i + 1, 0)
        self.syndrome_bit = np.array([0, *(1 << i for i in range(15))], np.int64)
        # pairs of flips whose positions XOR to a syndrome lead to the codewords at distance two
        self.pairs = [np.array([(1 << i) | (1 << j) for i in range(15) for j in range(i) if (i + 1) ^ (j + 1) == s], np.int64) for s in range(16)]

    def homes_and_visits(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(indices of fp, anchor keys, whether home) for each kind of move to an anchor."""
        everyone = np.arange(len(fp))
        for p, bits in enumerate(self.projections):
            v = np.zeros(len(fp), np.int64)
            for to, bit in enumerate(bits):
                v |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << to
            key = np.int64(p) << 58
            s = self.syndrome[v & 0x7FFF]
            home = v ^ self.syndrome_bit[s]
            yield everyone, home | key, True
            if not self.slack:
                continue
            raw = [1 << i for i in range(15, len(bits))]
            for flip in raw:  # distance 1 or 2: one other bit, with the home's own flip
                yield everyone, (home ^ flip) | key, False
            inside = everyone[s == 0]  # a codeword may also go two raw bits away
            for a, b in itertools.combinations(raw, 2):
                if len(inside):
                    yield inside, (home[inside] ^ a ^ b) | key, False
            for which in range(1, 16):  # other codewords at distance two of a word at distance one
                at = everyone[s == which]
                for flip in self.pairs[which] if len(at) else ():
                    yield at, (v[at] ^ flip) | key, False


def _placed(cover: Covering):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at, key, home in cover.homes_and_visits(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[at], pa.int64()), pa.array(np.full(len(at), 0 if home else 1, np.int8))], names=["anchor", "fp", "visit"])

    return place


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes over links a-b."""
    lab = np.arange(n)
    while len(a):
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        while not np.array_equal(lab, lab[lab]):
            lab = lab[lab]
        open_ = lab[a] != lab[b]
        if not open_.any():
            break
        # link the roots too, so that long chains settle in few rounds
        hi, lo = np.maximum(lab[a[open_]], lab[b[open_]]), np.minimum(lab[a[open_]], lab[b[open_]])
        np.minimum.at(lab, hi, lo)
    return lab


def bucket_links(key: np.ndarray, fp: np.ndarray, visit: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between points of equal key, as a forest: each linked point with the least it reaches.

    Rows come sorted by key, homes first. Each home is compared with all rows after it in its bucket.
    """
    nodes, ids = np.unique(fp, return_inverse=True)
    u = fp.view(np.uint64)
    ends = np.searchsorted(key, key, side="right")
    at = np.flatnonzero(visit == 0)
    till = ends[at]
    lefts, rights, held, step = [], [], 0, 1
    parents = np.arange(len(nodes))

    def settle() -> None:
        nonlocal lefts, rights, held, parents
        a, b = np.concatenate([ids[x] for x in lefts]), np.concatenate([ids[x] for x in rights])
        kept = parents != np.arange(len(nodes))
        parents = _roots(len(nodes), np.concatenate([a, np.flatnonzero(kept)]), np.concatenate([b, parents[kept]]))
        lefts, rights, held = [], [], 0

    while len(at):
        if len(at) < 64 and step > 64:  # few long buckets: a home at a time
            for i, e in zip(at.tolist(), till.tolist(), strict=True):
                hit = i + step + np.flatnonzero(np.bitwise_count(u[i] ^ u[i + step : e]) <= most_bits)
                lefts.append(np.full(len(hit), i)), rights.append(hit)
                held += len(hit)
                if held > 2_000_000:
                    settle()
            break
        near = np.bitwise_count(u[at] ^ u[at + step]) <= most_bits if (at + step < till).all() else None
        if near is None:
            live = at + step < till
            at, till = at[live], till[live]
            continue
        lefts.append(at[near]), rights.append(at[near] + step)
        held += int(near.sum())
        if held > 2_000_000:
            settle()
        step += 1
    if lefts:
        settle()
    linked = np.flatnonzero(parents != np.arange(len(nodes)))
    return nodes[linked], nodes[parents[linked]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition -> links; a bucket that goes over a batch's end is carried on."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def out(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        code = parts[0]  # equal (anchor, first, second) are equal numbers
        u, v = bucket_links(code, parts[1], parts[2])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    last, base = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        new = np.ones(b.num_rows, bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        new[0] = last is None or tuple(c[0] for c in cols[:3]) != last
        code = base + np.cumsum(new)
        base, last = int(code[-1]), tuple(c[-1] for c in cols[:3])
        held.append((code, cols[3], cols[4]))
        rows += b.num_rows
        if rows >= 200_000:
            code, fp, visit = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(code, code[-1]))
            if cut:
                yield out((code[:cut], fp[:cut], visit[:cut]))
            held, rows = [(code[cut:], fp[cut:], visit[cut:])], len(code) - cut
    if rows:
        yield out(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(points: DataFrame, n_points: int, scratch: Scratch, chunk: int = CHUNK, few: int = FEW_POINTS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all that are at 4 bits or fewer."""
    cover = Covering(3, 1) if n_points <= few else Covering(5, 2)
    placed = points.select("fp").mapInArrow(_placed(cover), "anchor long, fp long, visit byte")
    hot = scratch.table(placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        placed = placed.join(small(hot, n_hot), "anchor", "left")
        placed = placed.withColumn("k", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("anchor", F.least("c", "j").alias("p"), F.greatest("c", "j").alias("q"), "fp", "visit")
    else:
        placed = placed.select("anchor", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp", "visit")
    return placed.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q", "visit").mapInArrow(_compared, "u long, v long").distinct()


def rooted(points: DataFrame, stays: str, scratch: Scratch, chunk: int = CHUNK, few: int = FEW_POINTS) -> DataFrame:
    """Distinct fingerprints (fp, least, n) -> fp, n, first: the least ``stays`` of all points of the component.

    ``stays`` is an expression over ``least``. ``n`` is carried: the number of rows of a fingerprint.
    """
    n_points = points.count()
    edges = scratch.table(near_links(points, n_points, scratch, chunk, few), "edges")
    roots = scratch.table(components(edges, scratch), "roots")
    scratch.drop("edges", "hot-anchors", *STEPS)
    found = scratch.table(points.join(roots, points.fp == roots.u, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = scratch.table(found.groupBy("root").agg(F.expr(stays).alias("first"), F.count(F.lit(1)).alias("points")), "firsts")
    out = scratch.table(matched(found, firsts, ["root"], "points", n_points, F.col("fp")).select("fp", "n", "found.first"), "by-fp")
    scratch.drop("points", "roots", "rooted", "firsts")
    return out


def near_dedup(docs: DataFrame, chunk: int = CHUNK, few: int = FEW_POINTS) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, fingerprint, component_id, one row per input row.

    Whole texts are lower-cased (A-Z) and cut into words at ASCII white space; null or blank text has
    fingerprint zero and is linked like any other. component_id is the smallest doc_id reachable over
    links of 4 bits or fewer; null ids are reachable but never smallest, unless a component has no
    other. Repeated rows share fingerprint and component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    fps = scratch.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fps")
    points = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    by_fp = rooted(points, "min(least)", scratch, chunk, few)
    found = matched(fps, by_fp, ["fp"], "n", fps.count(), F.monotonically_increasing_id())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("found.first").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, one with its smallest doc_id.

    A row goes for what its own text is like, whatever other rows have its id: rows are numbered and
    written with their fingerprints, and chosen by number. A null id is taken where there is no other.
    Null, empty and blank texts have fingerprint zero, so one of them stays; of repeated rows one
    stays. Whole texts are read, however long. Columns may have any names; an empty table stays empty.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "near-copies")
    at = docs.columns.index("text")
    fp_, row_, gone_ = unused(docs.columns, "fp", "row", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t) for t in b.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64), pa.int64())], names=[*b.schema.names, fp_])

    printed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp_, LongType())]))
    rows = scratch.table(printed.withColumn(row_, F.monotonically_increasing_id()), "rows")
    light = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp_).alias("fp"), F.col(row_).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    by_fp = rooted(scratch.table(light.groupBy("fp").agg(first.alias("least"), F.count(F.lit(1)).alias("n")), "points"), "min(least).row", scratch)
    found = matched(light, by_fp, ["fp"], "n", light.count(), F.xxhash64("row"))
    gone = scratch.table(found.filter("row <> found.first").select(F.col("row").alias(gone_)), "gone")
    scratch.drop("by-fp")
    return rows.join(small(gone, gone.count()), F.col(row_) == F.col(gone_), "left_anti").select(*docs.columns)
