"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .workers import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a cluster session is
    refused, as its executors could not see such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lode-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


_collecting: list[list[Scratch]] = []


@contextlib.contextmanager
def collected() -> Iterator[list[Scratch]]:
    """A list of the scratch folders that are opened inside."""
    made: list[Scratch] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.remove(made)


def free(folders: list[Scratch], docs: DataFrame) -> list[Scratch]:
    """Deletes those of the folders that ``docs`` does not read; returns the others."""
    if not folders:
        return []
    read = docs.inputFiles()
    kept = [f for f in folders if any(f.name in path for path in read)]
    for f in folders:
        if f not in kept:
            f.drop("")
    return kept


class Scratch:
    """Written tables of one operator run, in a folder of their own below the shared folder.

    A table cuts lineage as a checkpoint does, and survives the loss of executors. ``drop`` frees
    one that no later plan reads; what a result still reads stays until the session's owner clears
    the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.name}"
        for made in _collecting:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def put(self, name: str, data: bytes) -> None:
        """A file of this content, on whatever file system the shared folder is."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
