"""Keywords of a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that never count as keywords.
STOP_WORDS = (
    "a", "an", "and", "at", "check", "compare", "comparison", "did", "for", "from",
    "how", "i", "in", "is", "last", "list", "me", "month", "much", "my", "on", "show",
    "spend", "spending", "the", "this", "to", "top", "transactions", "transaction",
    "week", "what", "year", "yesterday", "today", "up",
)

# Words that name a merchant whenever they occur in a question.
KNOWN_MERCHANTS = (
    "starbucks", "uber", "amazon", "netflix", "delta", "target", "walmart", "whole",
    "foods", "trader", "joe", "city", "water", "verizon", "shell", "airbnb", "spotify",
    "cvs",
)

MIN_LENGTH = 3


def _words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def keywords(query: Column) -> Column:
    """Distinct keywords in alphabetical order; they are alternatives, so order is free."""
    kept = F.array_except(letter_runs(query), _words(STOP_WORDS))
    return F.array_sort(F.filter(kept, lambda word: F.length(word) >= MIN_LENGTH))


def merchant_keywords(found: Column, known: Sequence[str] = KNOWN_MERCHANTS) -> Column:
    """Keywords to look for in merchant names: only the known ones if there are any."""
    named = F.array_intersect(found, _words(known))
    return F.when(F.size(named) > 0, named).otherwise(found)


def matches(value: Column, wanted: Column) -> Column:
    """Whether any of the wanted words is part of the value, ignoring case."""
    text = F.lower(F.coalesce(value, F.lit("")))
    return F.exists(wanted, lambda word: F.contains(text, word))
