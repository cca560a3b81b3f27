import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("kept", StringType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with a column whose name clashes with results."""

    def make(rows):
        return spark.createDataFrame([(*row, *("en", "s")[len(row) - 2 :], "clash") for row in rows], DOCS)

    return make


#: Nulls, empty and blank texts, a very long text, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 20_000), (5, "same"), (6, "same"), (6, "same"), (None, "same"), (7, "Ünï cödé\x0b x")]


@pytest.fixture(scope="session")
def odd():
    return ODD
