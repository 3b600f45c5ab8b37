import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, copies long, key string, cls long, n long, base string"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["the", "ing", "er", "an", "ou", "st"]) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    rest = (None,) * 7
    long = words(1, 12_000)
    rows = [
        (1, None, "en", "a", None, *rest),
        (2, "", "en", None, 0, *rest),
        (3, " \t\n ", None, "b", 4, *rest),
        (4, long, "en", "a", len(long), 0.5, 1, 2, "k", 3, 4, "x"),
        (5, words(2, 60), "de", "b", 1, *rest),
        (5, words(2, 60), "de", "b", 1, *rest),
        (6, words(2, 60), None, None, None, *rest),
        (None, words(3, 40), "fr", "c", 2, *rest),
        (None, None, None, None, None, *rest),
        (7, "café \U0001f600 12345 ß 中文 naïve", "fr", "c", 3, *rest),
        (8, "one two three", "en", "a", 13, *rest),
        (9, "One TWO three", "en", "a", 13, *rest),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
