"""Small messy tables that every operator must take."""

import pytest

MESSY = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "One two three four five", "en", "a", 1), (3, "One two three four five", "en", "a", 1),
    (None, "one TWO three four five", None, "b", 2), (4, "Écrire à x@y.fr ou +33 1 42 68 53 00.\n\nÀ demain", "fr", "a", 3),
    (5, "word " * 30000, "en", "a", 4), (6, "x" * 200000, "en", None, 5), (7, "\n\n \t\n", "de", "a", 6), (8, "ÉCRIRE", "fr", "a", 7),
    (9, "10.0.0.256: 4111 1111 1111 1111, 10.1.2.3", "en", "c", 8), (10, "a\x1cb   ² ½ 中文 😀😀 ＡＢ", "zh", "c", 9),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def messy(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(MESSY, COLUMNS).repartition(3)
    clash = ["_place", "_metadata", "_key", "_doc", "_mark", "_spans", "_gone", "hits", "words", "lead", "row", "fp", "node", "digest", "locator", "base", "spans", "start", "cell", "seq", "shard", "cluster", "length", "t", "w", "kept", "score", "component_id", "limit", "n"]
    return docs.withColumns({c: F.lit("extra") for c in clash})


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
