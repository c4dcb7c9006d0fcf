"""Small tables of documents with awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "en", "b"),
    (6, "one", "en", None),
    (7, "ONE", "en", "b"),
    (8, "x" * 5000, "de", "b"),
    (9, "ß é 日本 😀 ñandú " * 40, "es", "c"),
    (10, "a b c d e f g h i j " * 300, "en", "c"),
    (None, "a row without an id but with some words in it", "en", "c"),
    (11, "line one here\nline one here\n\n## | % line two", None, "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    names = ["id", "key", "word", "n", "score", "shard", "spans", "label", "words", "root", "_h", "w", "bits", "toxic", "item", "token"]
    return awkward.select("*", *(F.lit("clash").alias(c) for c in names))
