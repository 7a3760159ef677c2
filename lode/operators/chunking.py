"""Chunking strategies: documents -> ordered chunk rows with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import dot
from .retrieval import DIM, hashed_counts

SIZE, OVERLAP, SEMANTIC_THRESHOLD, PREFIX = 400, 50, 0.5, 80
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
METHODS = ("Recursive", "By Sentence", "By Markdown Headers", "Semantic")


def validate(size: int, overlap: int) -> None:
    if size < 1:
        raise ValueError(f"chunk_size must be >= 1, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be in [0, chunk_size), got {overlap}")


def split_sentences(text: str) -> list[str]:
    """Pieces after a full stop, exclamation or question mark with white space, stripped, blanks dropped."""
    return [x for p in _SENTENCE.split(text) if (x := p.strip())]


def pack_sentences(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed up to ``size``, each chunk opening with the last sentences that fit ``overlap``."""
    out: list[str] = []
    current: list[str] = []
    n = 0
    for s in split_sentences(text):
        if current and n + len(s) > size:
            out.append(" ".join(current))
            first, n = len(current), 0
            while first and n + len(current[first - 1]) <= overlap:
                first -= 1
                n += len(current[first]) + (n > 0)
            current = current[first:]
        current.append(s)
        n += len(s) + 1
    return [*out, " ".join(current)] if current else out


SPLITS = ("\n\n", "\n", " ", "")


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, splits: tuple[str, ...] = SPLITS) -> list[str]:
    """Split at the coarsest separator present, merge small pieces up to ``size``, recurse into large ones."""
    at = next(i for i, s in enumerate(splits) if not s or s in text)
    sep, finer = splits[at], splits[at + 1 :]
    head, *tail = text.split(sep) if sep else ["", *text]
    pieces = [p for p in (head, *(sep + x for x in tail)) if p]
    out: list[str] = []
    small: list[str] = []
    for piece in [*pieces, None]:
        if piece is not None and len(piece) < size:
            small.append(piece)
            continue
        if small:
            out += _merged(small, size, overlap)
            small = []
        if piece is not None:
            out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Windows of consecutive pieces up to ``size``; a new window keeps at most ``overlap`` of the last."""
    out, first, total = [], 0, 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and i > first:
            out.append("".join(pieces[first:i]).strip())
            while total > overlap or total and total + len(piece) > size:
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [x for x in out if x]


def header_sections(text: str) -> list[tuple[tuple[tuple[int, str], ...], str]]:
    """(header path, content) of each run of text under one path; fenced code has no headers."""
    path: dict[int, str] = {}
    out: list[tuple[tuple[tuple[int, str], ...], list[str]]] = []
    paragraph: list[str] = []
    fence = ""

    def close() -> None:
        if not paragraph:
            return
        key, body = tuple(sorted(path.items())), "\n".join(paragraph)
        if out and out[-1][0] == key:
            out[-1][1].append(body)
        else:
            out.append((key, [body]))
        paragraph.clear()

    for raw in text.split("\n"):
        line = raw.strip()
        mark = line[:3] if line[:3] in ("```", "~~~") else ""
        if fence or mark:
            fence = "" if fence and mark == fence else fence or mark
            paragraph.append(line)
            continue
        m = re.match(r"(#{1,3})(?: (.*))?$", line)
        if m:
            close()
            for level in [k for k in path if k >= len(m[1])]:
                del path[level]
            path[len(m[1])] = (m[2] or "").strip()
        elif line:
            paragraph.append(line)
        else:
            close()
    close()
    return [(key, "  \n".join(parts)) for key, parts in out]


def split_headers(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sections under their header path; those over ``size`` are split again."""
    out: list[str] = []
    for path, body in header_sections(text):
        head = "\n".join(f"{'#' * level} {title}" for level, title in path)
        full = f"{head}\n\n{body}" if head else body
        out += split_recursive(full, size, overlap) if len(full) > size else [full]
    return out or [text]


def group_sentences(text: str, threshold: float = SEMANTIC_THRESHOLD, cache: dict[str, int] | None = None) -> list[str]:
    """Runs of sentences whose neighbours' stand-in embeddings are alike; the rule of ``semantic_groups``.

    One sentence or none: the text as it is, or nothing if it is blank.
    """
    found, cache = split_sentences(text), {} if cache is None else cache
    if len(found) < 2:
        return [text] if found else []
    groups: list[list[str]] = []
    last = None
    for s in found:
        v = hashed_counts(s, cache, DIM)
        v /= np.linalg.norm(v) or 1.0
        if last is None or round(float(last @ v), 9) < threshold:
            groups.append([])
        groups[-1].append(s)
        last = v
    return [" ".join(g) for g in groups]


def splitter(method: str = "Recursive", size: int = SIZE, overlap: int = OVERLAP, threshold: float = SEMANTIC_THRESHOLD) -> Callable[[str], list[str]]:
    """Text -> chunk texts; an unknown method is Recursive. Semantic checks size and overlap and uses neither."""
    validate(size, overlap)
    if method == "Semantic":
        cache: dict[str, int] = {}
        return lambda t: group_sentences(t, threshold, cache)
    split = {"By Sentence": pack_sentences, "By Markdown Headers": split_headers}.get(method, split_recursive)
    return lambda t: split(t, size, overlap)


def chunk_texts(text: Column, method: str = "Recursive", size: int = SIZE, overlap: int = OVERLAP, threshold: float = SEMANTIC_THRESHOLD) -> Column:
    """array of chunk texts, by ``splitter``; null has none. A document at a time, in Arrow batches."""
    validate(size, overlap)

    @pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        split = splitter(method, size, overlap, threshold)
        return texts.map(lambda t: split(t) if t else [])

    return run(text)


def semantic_groups(sentences_: DataFrame, key: str, pos: str, text: str, embedding: str, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """(key, pos, text, unit vector) -> key, chunk_id, text: a new chunk where neighbours are unlike."""
    order = f"partition by {key} order by {pos}"
    flagged = sentences_.withColumn("_prev", F.expr(f"lag({embedding}) over ({order})"))
    flagged = flagged.withColumn("_new", F.when(F.col("_prev").isNotNull() & (F.round(dot(F.col("_prev"), F.col(embedding)), 9) < threshold), 1).otherwise(0))
    flagged = flagged.withColumn("chunk_id", F.expr(f"cast(sum(_new) over ({order} rows between unbounded preceding and current row) as int)"))
    parts = flagged.groupBy(key, "chunk_id").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("_parts"))
    return parts.select(key, "chunk_id", F.array_join(F.transform("_parts", lambda p: p["t"]), " ").alias("text"))


CHUNKS = "array<struct<chunk_id:int,text:string,start_char:int,end_char:int>>"


def offsets(text: str, chunks: list[str]) -> list[tuple[int, str, int, int]]:
    """(chunk_id, text, start_char, end_char): each chunk is sought after the start of the one before.

    A chunk whose first 80 characters are not found starts where the search did.
    """
    out, at = [], 0
    for i, c in enumerate(chunks):
        found = text.find(c[:PREFIX], at)
        begin = at if found < 0 else found
        out.append((i, c, begin, begin + len(c)))
        at = begin + 1
    return out


def with_offsets(text: Column, chunks: Column) -> Column:
    """array of struct(chunk_id, text, start_char, end_char), by ``offsets``."""

    @pandas_udf(CHUNKS)
    def run(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([offsets(t or "", list(c)) if c is not None else [] for t, c in zip(texts, parts, strict=True)])

    return run(text, chunks)


def chunk_documents(docs: DataFrame, method: str = "Recursive", size: int = SIZE, overlap: int = OVERLAP, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, chunk_id, text, start_char, end_char. No shuffle: one pass and an explode."""
    validate(size, overlap)

    @pandas_udf(CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        split = splitter(method, size, overlap, threshold)
        return texts.map(lambda t: offsets(t, split(t)) if t else [])

    return docs.select("doc_id", F.inline(run(F.col("text"))))


def summarise(chunks: DataFrame) -> DataFrame:
    """(method, text) -> method, n_chunks, avg_chars."""
    return chunks.groupBy("method").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"))

