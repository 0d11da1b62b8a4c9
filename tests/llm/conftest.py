import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash."""
    long = "word " * 30_000 + "x" * 50_000
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, " \t\n", "de", "s", 3), (4, long, "en", "s", 1), (5, "a b", "en", "s", 3),
        (6, "a b", "fr", "s", 3), (6, "a b", "fr", "s", 3), (None, "one two three four five six", "en", "s", 9), (7, "!!! 123 ???", "en", "s", 5),
        (8, "naïve 日本 \U0001f600 <|endoftext|> x", "en", "s", 5), (-50, "one two three four five six", "en", None, 9), (100, "seven", None, "s", 2),
    ]
    clash = ["score", "node", "g", "host", "guest", "digest", "size", "region", "label", "value", "key", "v", "n", "__text", "bytes", "sketch", "component_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'x' as {c}" for c in clash])
