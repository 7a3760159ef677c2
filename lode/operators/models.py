"""Model catalogue and pluggable clients: embeddings, image descriptions, completions.

A client is a function that the caller gives; it runs in Arrow batches on the executors, and what
goes wrong becomes a column, not a failed job. Offline the hashed stand-in embeds.
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from ..functions.text import l2_normalise

# Model, dimensions, provider.
CATALOGUE = (
    ("all-MiniLM-L6-v2", 384, "local"),
    ("all-mpnet-base-v2", 768, "local"),
    ("text-embedding-3-small", 1536, "openai"),
    ("text-embedding-3-large", 3072, "openai"),
    ("voyage-3.5-lite", 1024, "voyage"),
    ("gemini-embedding-001", 768, "google"),
    ("text-embedding-004", 768, "google"),
)
DEFAULT_DIM, DEFAULT_PROVIDER = 384, "local"
PROVIDERS = ("local", "openai", "voyage", "google")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "model string, dim int, provider string")


def resolve(model: str) -> tuple[int, str]:
    """(dimensions, provider); an unknown name is local with 384."""
    return next(((d, p) for m, d, p in CATALOGUE if m == model), (DEFAULT_DIM, DEFAULT_PROVIDER))


def embed_with(rows: DataFrame, client: Callable[[list[str]], list[list[float]]], provider: str = DEFAULT_PROVIDER, text: str = "text") -> DataFrame:
    """Adds embedding, a unit vector, from a client that takes a list of texts."""
    if provider not in PROVIDERS:
        raise ValueError(f"Unknown provider: {provider}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_v=[[float(x) for x in v] for v in client(b[text].fillna("").tolist())])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{columns}, _v array<double>").withColumn("embedding", l2_normalise(F.col("_v"))).drop("_v")


def complete_with(rows: DataFrame, client: Callable[[str], str], prompt: str = "prompt", to: str = "completion") -> DataFrame:
    """Adds the client's answer, and its error if there was one: for completions and image descriptions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for p in b[prompt]:
                try:
                    out.append(client(p)), errors.append(None)
                except Exception as e:  # the row carries it
                    out.append(None), errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(**{to: out, f"{to}_error": errors})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{columns}, {to} string, {to}_error string")


_REFERENCE = re.compile(r"!\[([^\]]*)\]\(\s*(data:image/[^)]+?)\s*\)")


def describe_images(md: Column, client: Callable[[str], str]) -> Column:
    """Images given as data URIs become ``[Image: description]``; what goes wrong stands in place of the description."""

    def described(m: re.Match) -> str:
        try:
            return f"[Image: {client(m[2]).strip()}]"
        except Exception as e:  # the text carries it
            return f"[Image: Image could not be described: {e}]"

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _REFERENCE.sub(described, t) if t is not None else None)

    return run(md)


def client_for(make: Callable[[str], Callable[[str], str]], key: str | None = None, variable: str = "LODE_API_KEY") -> Callable[[str], str] | None:
    """A client made with a key, the given one or the environment's; None without a key, or if it cannot be made."""
    key = key or os.environ.get(variable)
    if not key:
        return None
    try:
        return make(key)
    except Exception as e:
        logging.getLogger(__name__).warning("no client: %s", e)
        return None


def pdf_page_rows(files: DataFrame) -> DataFrame:
    """(path, content) -> path, page_no, text, n_images; files that cannot be read have no rows."""
    from ..sources.pdf import pdf_pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(path, *page) for page in pdf_pages(bytes(content))]
                except Exception:  # told apart by encrypted_pdfs and by the extraction's errors
                    continue
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "n_images"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, n_images int")


def scanned_pdfs(page_rows: DataFrame, sample_pages: int = 3, chars: int = 30, share: float = 0.6) -> DataFrame:
    """(path, page_no from 1, text, n_images) -> path, scanned: most of the first pages are images with hardly any text."""
    first = page_rows.filter(F.col("page_no") <= sample_pages)
    page = (F.length(F.trim(F.coalesce("text", F.lit("")))) < chars) & (F.col("n_images") > 0)
    by = first.groupBy("path").agg(F.sum(page.cast("int")).alias("n"), F.count(F.lit(1)).alias("pages"))
    return by.select("path", (F.col("n") >= F.greatest(F.lit(1.0), F.col("pages") * share)).alias("scanned"))


def encrypted_pdfs(files: DataFrame) -> DataFrame:
    """(path, content) -> path, encrypted: the file does not open with the empty password."""
    from ..sources.pdf import needs_password

    @pandas_udf(BooleanType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: needs_password(bytes(c)) if c is not None else False)

    return files.select("path", run("content").alias("encrypted"))
