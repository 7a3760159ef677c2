"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file is a run of blocks, each ended by a zero byte; a block holds whole documents and stands by
itself. The ids of a block are replaced by their ranks by falling frequency in the block, so that
common ids take one byte. Four ranks share a control byte with their lengths (1 to 4 bytes, two bits
each); control bytes and data bytes are stored apart. Ranks are decoded by table lookup: a control
byte gives four lengths, lengths give offsets, offsets gather the bytes.

Block layout, little-endian: magic, then documents, ids, table length, control bytes, data bytes and
CRC-32 of what follows (unsigned 32 bits each); doc_id (64 bits each), presence of doc_id (a byte each),
ids per document (32 bits each); ids by rank (32 bits each); control bytes; data bytes.

Files are written by Spark's own text sink, whose commit protocol copes with lost executors and
repeated tasks, on any file system that Spark writes to; they are read back as binary files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, small
from .tokens import Encoder, default_path, text_groups

MAGIC = b"LTB1"
HEAD = struct.Struct("<4s6I")
END_ID = 2
BLOCK_IDS = 1 << 18
#: Blocks of a file. A file stays far below the 2 GB that one row may have, unless single texts are huge.
FILE_BLOCKS = 24
#: Parts (tasks of the writer) whose files are summed together.
SUMMED_PARTS = 1_024
ENDED = b"\0"
#: Number of the part and, in it, of the file.
FILE_NAME = re.compile(r"part-(\d+)-[^/]*-c(\d+)[^/]*$")
#: Lengths of the four values that a control byte stands for, first value in the lowest bits.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_values(v: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values; the last control byte is filled with ones."""
    v = np.ascontiguousarray(v, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.concatenate([size - 1, np.zeros(-len(v) % 4, np.uint8)]).reshape(-1, 4).astype(np.uint8)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    wide = int(size.max(initial=1))
    data = v.view(np.uint8).reshape(-1, 4)[:, :wide][np.arange(wide) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of encode_values, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """A block of documents given as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    if len(ids) and ids.max() < 1 << 20:  # vocabularies are small: counting needs no sort of the ids
        counts = np.bincount(ids)
        table = np.flatnonzero(counts).astype(np.uint32)
        place = np.zeros(len(counts), np.uint32)
        place[table] = np.arange(len(table), dtype=np.uint32)
        inverse, counts = place[ids], counts[table]
    else:
        table, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((table, -counts))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = encode_values(rank[inverse])
    body = b"".join([
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), bytes(i is not None for i in doc_ids), np.array([len(d) // 4 for d in docs], "<u4").tobytes(), table[order].astype("<u4").tobytes(), control, data,
    ])
    return HEAD.pack(MAGIC, len(docs), len(ids), len(table), len(control), len(data), zlib.crc32(body)) + body


def read_blocks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, ids) of each block of a file."""
    at = 0
    view = memoryview(content)
    while at < len(view):
        magic, docs, n, distinct, n_control, n_data, crc = HEAD.unpack_from(view, at)
        at += HEAD.size
        size = 13 * docs + 4 * distinct + n_control + n_data
        body = view[at : at + size]
        if magic != MAGIC or zlib.crc32(body) != crc or bytes(view[at + size : at + size + 1]) != ENDED:
            raise ValueError("damaged token block")
        at += size + 1
        doc_ids = np.frombuffer(body, "<i8", docs)
        there = np.frombuffer(body, np.uint8, docs, 8 * docs)
        lengths = np.frombuffer(body, "<u4", docs, 9 * docs).astype(np.int64)
        table = np.frombuffer(body, "<u4", distinct, 13 * docs)
        cut = 13 * docs + 4 * distinct
        ids = table[decode_values(body[cut : cut + n_control], body[cut + n_control :], n)] if n else np.zeros(0, "<u4")
        yield [int(i) if t else None for i, t in zip(doc_ids, there, strict=True)], lengths, ids


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, file_blocks: int = FILE_BLOCKS) -> None:
    """Encodes every whole text (null: empty) and writes token files in ascending doc_id order.

    Names of files sort as their documents do. Null ids come first; rows of one doc_id stand in the
    order of a hash of their texts.
    """
    arrow_batches(docs.sparkSession)
    path, end = path or default_path(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        ids: list[int | None] = []
        held: list[bytes] = []
        n = 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, texts in text_groups(b.column(1).to_pylist()):
                for i, data in enumerate(encoder.encode(texts)):
                    ids.append(doc_ids[first + i])
                    held.append(data + end)
                    n += len(held[-1]) // 4
                    if n >= block_ids:
                        yield pa.RecordBatch.from_arrays([pa.array([encode_block(ids, held)], pa.binary())], names=["block"])
                        ids, held, n = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([encode_block(ids, held)], pa.binary())], names=["block"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    blocks = rows.select("doc_id", "text").mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.mode("overwrite").option("lineSep", ENDED.decode()).option("maxRecordsPerFile", file_blocks).text(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decodes token files: part, chunk, place in the file, doc_id, n_tokens, ids_crc32 (, ids) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*(b.column(i) for i in range(2)), strict=True):
                part, chunk = map(int, FILE_NAME.search(path.as_py()).groups())
                place, local = 0, 0
                for doc_ids, lengths, ids in read_blocks(content.as_py()):
                    ends = np.cumsum(lengths)
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    n = len(doc_ids)
                    cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, chunk, np.int32)), pa.array(np.arange(place, place + n)), pa.array(local + ends - lengths), pa.array(doc_ids, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "place", "local", "doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                    place, local = place + n, local + int(lengths.sum())

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    # nothing is computed before Python: a projection would copy the contents
    return files.select("path", "content").mapInArrow(run, "part int, chunk int, place long, local long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_index(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, file_blocks: int = FILE_BLOCKS) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, start, n_tokens, ids_crc32: written to token files and read back from them.

    start counts the ids of all documents before; null ids come first. Null text counts as empty.
    Repeated rows are written each. Whole texts are written, however long; columns other than doc_id and
    text are not read, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, scratch.path("files"), path, end_id, block_ids, file_blocks)
    index = scratch.table(read_tokens(docs.sparkSession, scratch.path("files")), "index")
    scratch.drop("files")
    before = scratch.table(_before(index.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))), "before")
    return index.join(small(before, before.count()), ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _before(files: DataFrame, parts: int = SUMMED_PARTS) -> DataFrame:
    """(part, chunk, n) -> part, chunk, before: the sum of n over all files that sort before, in two levels.

    Files are summed in groups of so many parts, the groups' totals in one task.
    """
    grouped = files.withColumn("g", F.expr(f"part div {parts}"))
    running = "rows between unbounded preceding and current row"
    totals = grouped.groupBy("g").agg(F.sum("n").alias("t")).select("g", F.expr(f"sum(t) over (order by g {running}) - t").alias("base"))
    within = grouped.withColumn("own", F.expr(f"sum(n) over (partition by g order by part, chunk {running}) - n"))
    return within.join(F.broadcast(totals), "g").select("part", "chunk", (F.col("base") + F.col("own")).alias("before"))
