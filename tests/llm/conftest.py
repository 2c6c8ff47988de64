import pytest
from pyspark.sql import functions as F, types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# names that operators use inside
CLASHES = ["_doc", "_key", "_text", "node", "anchor", "set_id", "ids", "kept_", "tokens", "gram", "words", "sketch_", "_piece", "region", "places"]


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with names that operators use."""
    long = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog and runs away from all of them today", "en", "a", 1),
        (0, "the quick brown fox jumps over the lazy dog and runs away from all of them today", "en", "a", 1),
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "a row without an id but with some text", "en", "a", 3),
        (None, None, None, None, None), (4, long, "en", None, len(long)), (5, long + " end", "en", None, len(long) + 4),
        (6, "x", None, "b", 1), (7, "é　ß 日本語 \U0001f600 \u0085 d'accord l'été 12½", "fr", "b", 9), (8, "the quick brown fox", "en", "b", 19),
        (9, "the quick brown fox", "en", "b", 19), (10, "aaaa aaaa aaaa aaaa " * 30, "de", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("extra") for c in CLASHES})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
