import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, tile int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, other columns whose names clash with the operators' own."""
    prose = "the quick brown fox jumps over the lazy dog and runs far away into the dark wood"
    rows = [
        (1, prose, "en", "a", 80, "k", 0.5, 1), (1, prose, "en", "a", 80, "k", 0.5, 1), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, "k", 0.5, 1),
        (None, prose + " again", "en", None, 5, "k", 0.5, 1), (4, LONG, "xx", "b", None, "k", 0.5, 1), (5, "12 + 34 = 46!", "en", "b", 12, "k", 0.5, 1), (6, "word", "en", "b", 4, "k", 0.5, 1), (7, prose, None, "b", 4, "k", 0.5, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (4, 0, 1), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
