"""Questions to windows and keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.keywords import KNOWN_MERCHANTS, keywords, merchant_keywords
from tallymill.functions.text import trimmed
from tallymill.functions.windows import window_of


def clean_questions(questions: DataFrame) -> DataFrame:
    """Questions without surrounding blanks; empty ones are dropped."""
    cleaned = questions.withColumn("query", trimmed(F.col("query")))
    return cleaned.filter(F.length("query") > 0)


def parse_questions(
    questions: DataFrame, known: Sequence[str] = KNOWN_MERCHANTS
) -> DataFrame:
    """Add window, keywords, merchant keywords and the ``needle``.

    Questions with equal needle and window have equal answers, so everything after
    this step works per (needle, window) and is joined back to questions at the end.
    The needle is empty when a question has no keywords. A null question asks for nothing
    in particular, like an empty one: it has no keywords and covers all time.
    """
    text = F.coalesce("query", F.lit(""))
    parsed = questions.select(
        "question_id",
        "query",
        window_of(text).alias("window"),
        keywords(text).alias("keywords"),
    )
    return parsed.withColumn(
        "merchant_keywords", merchant_keywords(F.col("keywords"), known)
    ).withColumn("needle", F.array_join("keywords", " "))


def distinct_asks(parsed: DataFrame) -> DataFrame:
    """(needle, window, keywords, merchant_keywords), each ask once."""
    return parsed.select("needle", "window", "keywords", "merchant_keywords").distinct()


def windows_asked(asks: DataFrame) -> list[str]:
    """Names of the windows in use, nine at most."""
    return [window for (window,) in asks.select("window").distinct().collect()]
