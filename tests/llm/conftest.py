import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def documents(spark):
    """A documents table from texts or (doc_id, text[, source]) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc, text, source = (i, r, f"s{i % 3}") if isinstance(r, str) or r is None else (*r, f"s{i % 3}")[:3]
            full.append((doc, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
