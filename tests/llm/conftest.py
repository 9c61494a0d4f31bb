import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASH = ("row", "key", "kept", "size", "start", "target", "cls", "n_words", "spans", "score")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    chance = random.Random(seed)
    return " ".join(f"w{chance.randrange(vocabulary)}x" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60), "en", "a", 10),
        (1, prose(2, 60), "en", "a", 10),
        (2, prose(2, 60), "en", "b", 10),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (5, " \t\n ", None, "b", 4),
        (None, prose(3, 50), "de", "b", None),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (6, "short", "de", "a", 5),
        (7, long, "en", "b", len(long)),
        (8, long + " tail", "en", "b", len(long) + 5),
        (9, "héllo 世界 🎈 naïve", "fr", "c", 17),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with the operators' own."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in CLASH:
        docs = docs.selectExpr("*", f"'extra' AS {name}")
    return docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted(map(str, df.select(*names).collect()))
