"""All queries of the engine: importing the modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ingest, markdown, search, sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every benchmark item over all documents."""
    return QUERIES["hybrid_search"](spark, sf_dir)
