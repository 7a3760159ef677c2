"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage is written as Parquet, before the next one is called, and read again as its input. All but the last return the
columns of ``documents``, whatever their names; the last returns the packed pieces. An empty table
stays empty through all of them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lode.llm.common import Scratch
from lode.llm.exact_dedup import drop_exact_copies
from lode.llm.langid import keep_identified
from lode.llm.mixing import mixed_documents
from lode.llm.near_dedup import drop_near_copies
from lode.llm.packing import pack
from lode.scratch import collected, free

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[Scratch] = []


def _stage(f: Stage) -> Stage:
    """A stage that first deletes the working tables of stages before it.

    Their results have been written by then: a table that ``docs`` itself still reads stays.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = [s for s in _left if s.spark.sparkContext is spark.sparkContext]
        _left[:] = free(_left, docs)
        with collected() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one or more known languages; ``und`` goes: null texts and those without a letter.

    Rows are judged each by its own text, whatever their ids, repeats and other columns. Without a
    row to learn from, all go.
    """
    return keep_identified(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each set of equal texts, one with the largest doc_id; null ids are smallest."""
    return drop_exact_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component, one with the smallest doc_id; a null id only where there is no other."""
    return drop_near_copies(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the sources' targets; rows with null or wordless text take no words and go."""
    return mixed_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the mix took into sequences: a row per piece, of repeated rows each."""
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Language models, fingerprint components and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
