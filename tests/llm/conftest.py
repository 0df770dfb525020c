import zlib

import pytest
from pyspark.sql import functions as F

EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "The quick brown fox jumps over the lazy dog again and again"),
    (7, "The quick brown fox jumps over the lazy dog again and again"), (8, "THE quick brown fox jumps over the lazy dog again and again"), (9, "..."), (10, "é ü 😀 ß"),
    (12, "word " * 5000), (13, "x" * 20000), (None, "a row without an id"), (6, "The quick brown fox jumps over the lazy dog again and again"),
]


@pytest.fixture()
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and a column with a clashing name."""
    df = spark.createDataFrame([(i, t, "en", None if i == 4 else "s") for i, t in EDGE], "doc_id bigint, text string, lang string, source string")
    return df.withColumns({"score": F.lit("clash"), "ids": F.lit("clash"), "n": F.lit(1), "rank": F.lit(None).cast("string"), "rate": F.lit(0)})


@pytest.fixture()
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def fold(i, of):
    return zlib.crc32(str(i).encode()) % of
