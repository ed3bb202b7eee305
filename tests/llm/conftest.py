import pytest

from segprofile.llm.tables import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, rep string, n int, label int, _row string, words string"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text, lang, source) with further columns whose names operators use inside."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), 0.5, 3, "r", 1, 7, "x", "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


LONG = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids."""
    rows = [
        (None, None, None, None),
        (None, "some words without an id", "en", "b"),
        (1, "", "en", "a"),
        (2, None, "en", "a"),
        (3, " \t\n ", "en", None),
        (4, LONG, "en", "a"),
        (4, LONG, "en", "a"),
        (5, "a", "en", "b"),
        (6, "12 !! 34", None, "b"),
        (7, "same id once", "en", "b"),
        (7, "same id twice or more", "en", "b"),
        (8, "", "en", "a"),
    ]
    return documents(rows)


@pytest.fixture(scope="session")
def none(documents):
    return documents([])
