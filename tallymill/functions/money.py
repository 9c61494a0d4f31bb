"""Dates and amounts read from text, and sentences written from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.schemas import MONEY


def parse_date(text: Column) -> Column:
    """ISO date; anything else, the empty text included, is unknown."""
    # An empty text is no date either, but costs no failed parse.
    return F.try_to_date(F.nullif(text, F.lit("")), "yyyy-MM-dd")


def parse_amount(text: Column) -> Column:
    """Amount in cents precision from text; anything but a number is unknown."""
    return text.try_cast(MONEY)


def is_income(category: Column) -> Column:
    return F.lower(F.coalesce(category, F.lit(""))) == "income"


# The answer sentence, around total and count.
SENTENCE = ("You spent $", " across ", " transactions.")


def spent_sentence(total_spend: Column, transaction_count: Column) -> Column:
    """The answer sentence, from exact amounts: format patterns take no decimals."""
    before, between, after = map(F.lit, SENTENCE)
    total = total_spend.cast("decimal(38,2)").cast("string")
    return F.concat(before, total, between, transaction_count.cast("string"), after)


def amount_text(amount: Column) -> Column:
    """Shortest decimal form with at least one digit after the point: 12.50 -> 12.5."""
    return F.regexp_replace(amount.cast(MONEY).cast("string"), "0$", "")
