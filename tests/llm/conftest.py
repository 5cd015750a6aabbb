import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, component_id int, key string"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the names of results."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the very big bad wolf today"
    texts = [(1, base), (2, base.upper()), (3, base + " again"), (4, ""), (5, None), (6, LONG), (7, LONG + " end"), (8, "  \n\t "), (9, "x"), (9, "x"), (10, "12 34 !!"), (None, base), (None, None), (11, "naïve Ünïcode ÀÉ 漢字 😀")]
    return [(i, t, None, None, None, "k", "s", 7, None) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
