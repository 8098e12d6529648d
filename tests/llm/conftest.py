import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, tiny and very long texts, repeated rows, and columns whose names operators use."""
    long_text = "The cat of the house went to the river and " * 6000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs to the river of the town", "en", "a", 77),
        (1, "The quick brown fox jumps over the lazy dog and runs to the river of the town", "en", "a", 77),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, "!!! ... ---", None, "b", 11), (None, "Der Hund und die Katze sind in dem Haus", "de", None, 39), (None, None, None, None, None),
        (5, long_text, "en", "b", len(long_text)), (6, "word", "en", "b", 4), (7, "x" * 300_000, None, "c", 300_000), (8, "Ünïcode élan   ñandú 你好 \U0001f600", "fr", "c", 25),
    ]
    df = spark.createDataFrame([(*r, "k", 9, 0.5, "s") for r in rows], DOCS + ", key string, size int, score double, spans string")
    return df


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
