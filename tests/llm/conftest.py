"""Small document tables with the awkward cases that every operator must take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Table of (doc_id, text) pairs or of whole rows."""

    def make(rows):
        full = [(*r, None, None, len(r[1] or "")) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, make_docs):
    """Nulls in every column, empty and blank texts, repeated rows, one long text, and clashing extra columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 60),
        (2, None, None, None, None), (None, "text without an id", "en", None, 3), (None, None, None, None, None),
        (3, "", "en", "a", 0), (4, " \n\t ", "de", "a", 4), (5, "!!! 123 ???", "fr", "b", 11),
        (6, "same row", "en", "a", 8), (6, "same row", "en", "a", 8), (7, "word " * 30_000, "en", "a", 150_000),
        (8, "x" * 200_000, None, "a", 200_000), (6, "same id, other text", "en", "a", 19),
    ]
    docs = make_docs(rows)
    return docs.toDF(*docs.columns).selectExpr("*", "1 AS TEXT", "'z' AS score", "2 AS Doc_Id", "3 AS text", "'k' AS c0", "7 AS slot")


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
