import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, ties and repeated rows, odd white space, one very long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "web", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "web", 7),
    (4, "The same Text, twice over and over", "en", "web", 34),
    (4, "The same Text, twice over and over", "en", "web", 34),
    (5, "the SAME text, twice over and over", "fr", None, 34),
    (None, "a row without an id and some words", "en", "web", 34),
    (None, None, None, None, None),
    (6, "one", "de", "web", 3),
    (7, "été à la plage insécable   ligne 日本語 \x1c odd", "fr", "book", 40),
    (8, "word " * 60_000, "en", "book", 300_000),
    (9, "x" * 200_000, "en", "book", 200_000),
    (10, "#$% & | <tag> \n\n line \n line \n line", "es", "code", 30),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(odd):
    """Further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("t", "w", "rep", "key", "label", "size", "h", "slice", "score", "digest", "n", "sig", "target", "src", "lines", "_id", "_text", "text_sha256", "copies", "row", "held_out", "predicted", "_score", "_keep", "_digest", "_sha", "_copies", "_copy", "_one", "_two", "_0", "_1", "_2", "first", "component_id", "kept", "c", "bits", "shard", "even")
    return odd.select("*", *(F.lit("x").alias(n) for n in names))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
