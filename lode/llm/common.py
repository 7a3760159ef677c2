"""Helpers shared by the training-data operators: size-checked broadcasts and ASCII folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401
from ..workers import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows up to which a table of fixed-width keys is broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000
#: Records in an Arrow batch that goes to a Python worker: bounds a batch of long texts.
ARROW_RECORDS = 1_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its measured number of rows is within the bound."""
    return F.broadcast(df) if rows <= most else df


def matched(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, spread: Column, most: int | None = None) -> DataFrame:
    """``rows`` and a column ``found``: the other columns of the row of ``table`` (unique by ``on``) with its key, or null.

    ``n`` of ``table`` tells how many of the ``total`` rows have its key. A table of ``most`` rows is
    broadcast. Of a larger one the hot keys are, those of over total / most rows: fewer than ``most``.
    Their rows are found where they stand and then dealt out by ``spread``, so that the join of the
    others has no hot key; ``rows`` are read once.
    """
    most = most or BROADCAST_ROWS
    keys = [F.col(c) for c in on]
    value = F.struct(*[c for c in table.columns if c not in on])

    def found(left: DataFrame, right: DataFrame, to: str, its: list[Column], hint: bool) -> DataFrame:
        names = [f"{to}_{i}" for i in range(len(its))]
        right = right.select(*[k.alias(name) for k, name in zip(keys if len(its) == len(keys) else [*keys, F.xxhash64(*on)], names, strict=True)], value.alias(to))
        equal = [k == F.col(name) for k, name in zip(its, names, strict=True)]
        return left.join(F.broadcast(right) if hint else right, equal, "left").drop(*names)

    if table.count() <= most:
        return found(rows, table, "found", keys, True)
    hot = F.col(n) > total // most
    out = found(rows, table.filter(hot), "hot", keys, True)
    here = F.col("hot").isNotNull()
    out = out.withColumn("dealt_by", F.when(here, spread).otherwise(F.xxhash64(*on)))
    out = found(out, table.filter(~hot), "cold", [*[F.when(~here, k) for k in keys], F.col("dealt_by")], False)
    return out.withColumn("found", F.coalesce("hot", "cold")).drop("hot", "cold", "dealt_by")


def lower_ascii(col: Column) -> Column:
    """Null as empty; A-Z to a-z and nothing else."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def id_crc(col: Column) -> Column:
    """CRC-32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def arrow_batches(spark: SparkSession, records: int = ARROW_RECORDS) -> None:
    """Bounds the batches that go to Python workers, and lets these import the package; never raises a smaller setting."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > records or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, records)


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as make it none of ``columns``, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
