import pytest

from lode.llm.common import UPPER  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, name string, h long, n long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} Of the" for i in range(40_000))
    rows = [
        (1, "Hello World, all rights reserved.", "en", "a", 1),
        (2, "hello world, ALL RIGHTS RESERVED.", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "fr", "b", 0),
        (6, long, "en", "b", len(long)),
        (7, long.upper(), "de", None, None),
        (8, "Äpfel äpfel éclair \U0001f600 12 34", "de", "c", 3),
        (8, "Äpfel äpfel éclair \U0001f600 12 34", "de", "c", 3),
        (None, "no id at all here", None, "c", 3),
        (9, "le chat est dans la maison et le chien", "fr", "a", 3),
        (10, "CC BY cc by cc-by General Public License", "en", "a", 3),
    ]
    return spark.createDataFrame([(*r, "x", "y", 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def named(odd):
    """The odd documents with columns named as the stages name their own."""
    from pyspark.sql import functions as F

    names = ["row", "_row", "ROW_", "gone", "_gone", "_gone_id", "_gone_sha", "_sha", "fp", "_fp", "piece", "at", "_h", "_p", "_id", "_size", "size", "place", "taken", "bytes", "len", "keep_id", "shard", "root", "block"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
