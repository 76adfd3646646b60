import pytest

#: Nulls, empty and long texts, repeated rows and ids, and columns whose names clash with those the operators use.
HARD = [
    (1, "The quick brown fox jumps over the lazy dog today.", "en", "s1"),
    (1, "The quick brown fox jumps over the lazy dog today.", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, None),
    (4, "   \n\t ", "de", "s2"),
    (5, "word " * 20_000, "en", "s2"),
    (None, "a row without an id but with words enough for a shingle", "en", "s3"),
    (6, "12345 67890", "en", "s3"),
    (7, "é", "fr", "s3"),
    (7, "another text under the same id as before, quite different from it", "fr", "s3"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, SCHEMA).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return df.withColumns({c: F.lit("clash") for c in ("key", "mark", "id", "token", "hash", "words", "n", "score", "component", "_gone", "row")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars bigint")
