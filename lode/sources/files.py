"""File sources and sinks: a folder of documents as rows of markdown, and results as text or tables."""

from __future__ import annotations

import csv
import io
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators.models import describe_images
from .office import docx_markdown, pptx_markdown
from .pdf import pdf_markdown

MAX_BYTES = 100 * 1024 * 1024
LEAST_CHARS = 10
Reader = Callable[[bytes], str]


def csv_markdown(content: bytes) -> str:
    """A pipe table; UTF-8, with or without a mark, or else Latin-1."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(c.replace("|", "∣").replace("\n", "<br>") for c in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


#: Readers by extension; where there are several, the next reads what one before fails on.
READERS: dict[str, Reader | tuple[Reader, ...]] = {"csv": csv_markdown, "docx": docx_markdown, "pptx": pptx_markdown, "pdf": pdf_markdown}
#: Setting that has images described, and the kinds of files whose images are.
DESCRIBE, DESCRIBED = "spark.lode.describeImages", ("pdf", "docx", "pptx")


def checked(path: str) -> str:
    """A path that may be read: absolute, or a URI, or below the temporary folder."""
    inside = os.path.realpath(path).startswith(os.path.realpath(tempfile.gettempdir()) + os.sep)
    if not (os.path.isabs(path) or inside or re.match(r"[a-z][a-z0-9+.-]*:/", path, re.I)):
        raise ValueError(f"Invalid file path: {path}")
    return path


def scan(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length, extension, content, error: files that are empty, too large or of an unknown kind have no content.

    Only accepted files are opened: the length is a filter that the source applies to its listing, and
    those refused are read without their content. Empty files come from the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(checked(path))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")
    known = F.col("extension").isin(*READERS)
    none = F.lit(None).cast("binary").alias("content")
    unknown = F.concat(F.lit("Unsupported file type: "), F.col("extension"))
    read = files.filter(F.col("length") <= max_bytes).select("path", "length", ext, "content").filter(known).withColumn("error", F.lit(None).cast("string"))
    other = files.filter(F.col("length") <= max_bytes).select("path", "length", ext, none).filter(~known).withColumn("error", unknown)
    large = files.filter(F.col("length") > max_bytes).select("path", "length", ext, none).withColumn("error", F.lit("File too large"))
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    seen = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("seen"))
    empty = listed.join(seen, listed.path == seen.seen, "left_anti").select("path", F.lit(0).cast("long").alias("length"), ext, none, F.lit("File is empty").alias("error"))
    return read.unionByName(other).unionByName(large).unionByName(empty)


def read_one(content: bytes, extension: str, readers: dict[str, Reader | tuple[Reader, ...]]) -> tuple[str | None, str | None]:
    """(text, error) of a file: its readers are tried in turn, whatever goes wrong with the one before."""
    error = f"no reader for {extension}"
    found = readers.get(extension, ())
    for reader in found if isinstance(found, tuple) else (found,):
        try:
            text = reader(content)
            if extension == "csv" or len(text.strip()) >= LEAST_CHARS:
                return text, None
            error = "almost no text"
        except Exception as e:  # any reader, any file: the row carries what went wrong
            error = f"{type(e).__name__}: {e}"
    return None, error


def extract(files: DataFrame, readers: dict[str, Reader | tuple[Reader, ...]] | None = None) -> DataFrame:
    """path, raw_markdown, error: each file by the readers of its extension; a failure is a row with its error."""
    by = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r.path, *((None, r.error) if r.error is not None else read_one(bytes(r.content), r.extension, by))) for r in b.itertuples()]
            yield pd.DataFrame(out, columns=["path", "raw_markdown", "error"])

    found = files.mapInPandas(run, "path string, raw_markdown string, error string")
    cleaned = X.strip_page_numbers(X.collapse_spaced_caps(F.col("raw_markdown")))
    return found.withColumn("raw_markdown", F.when(F.lower("path").endswith(".csv"), F.col("raw_markdown")).otherwise(cleaned))


def process(spark: SparkSession, path: str, readers: dict[str, Reader | tuple[Reader, ...]] | None = None, describe: Callable[[str], str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, three versions of the markdown, stats, error: the whole conversion of a folder.

    ``describe`` takes an image's data URI and gives its description; it is called for images of
    PDF, DOCX and PPTX files where the session's setting DESCRIBE is 1.
    """
    raw = extract(scan(spark, path, max_bytes), readers)
    rows = raw.withColumn("t", T.tables_to_lists(_html_pipes(F.col("raw_markdown"))))
    rows = rows.withColumn("tables_converted", X.attach_captions(F.col("t.md")))
    seen = F.col("tables_converted")
    if describe and spark.conf.get(DESCRIBE, "") == "1":
        seen = F.when(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*DESCRIBED), describe_images(seen, describe)).otherwise(seen)
    final = X.collapse_blank_lines(X.strip_sheet_names(X.rewrite_images(seen)))
    rows = rows.withColumn("final_markdown", final)
    stats = F.struct(F.col("t.tables").alias("tables_found"), X.count_images(F.col("tables_converted")).alias("images_found"), F.length("final_markdown").alias("char_count"))
    return rows.select("path", "raw_markdown", "tables_converted", "final_markdown", stats.alias("stats"), "error")


def _html_pipes(md):
    """HTML tables as pipe tables, where there are any."""
    return F.when(F.lower(md).contains("<table"), T.html_tables_to_pipes(md)).otherwise(md)


def write_markdown(rows: DataFrame, folder: str, text: str = "final_markdown", key: str = "path") -> None:
    """One text file per key value, in a folder named after it; keys whose names are equal have a digest added."""
    stem = F.regexp_extract(F.col(key).cast("string"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = rows.select(F.col(key).cast("string").alias("key"), F.regexp_replace(stem, "[^\\p{L}\\p{N}_-]", "_").alias("stem"), F.col(text).alias("value"))
    twice = named.groupBy("stem").agg(F.count_distinct("key").alias("n")).filter("n > 1").select("stem", F.lit(True).alias("twice"))
    named = named.join(twice, "stem", "left")
    name = F.concat("stem", F.when(F.col("twice"), F.concat(F.lit("_"), F.substring(F.md5(F.col("key").cast("binary")), 1, 12))).otherwise(F.lit("")), F.lit("_converted"))
    named.select(name.alias("name"), "value").write.mode("overwrite").partitionBy("name").text(folder)


def write_index(chunks: DataFrame, folder: str) -> None:
    """Chunks, forward index, postings, terms and vectors as tables, replacing what was there."""
    from ..operators import retrieval as R

    index = R.build_index(chunks, folder)
    stats, df = index.stats(), index.document_frequency()
    idf = df.join(R.ranking_idf(df, stats).withColumnRenamed("idf", "idf_rank"), ["corpus", "token"]).join(R.trace_idf(df, stats).withColumnRenamed("idf", "idf_trace"), ["corpus", "token"])
    for name, t in (("postings", index.postings()), ("terms", idf), ("vectors", index.vectors())):
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
