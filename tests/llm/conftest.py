import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()), StructField("id", StringType()),
                   StructField("score", StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], DOCS)

    return make


LONG = " ".join(f"word{k}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, blank and very long texts, repeated rows and repeated ids."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, LONG), (6, LONG), (6, LONG), (None, "null id text " * 20), (7, "x" * 50_000), (7, "other")]
