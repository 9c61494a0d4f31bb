"""Bank-feed records to flat transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.money import parse_amount, parse_date
from tallymill.schemas import MONEY

# Feed category code and the category it is filed under.
CATEGORY_OF_CODE = {
    "FOOD_AND_DRINK": "Dining",
    "TRAVEL": "Travel",
    "TRANSPORTATION": "Transportation",
    "ENTERTAINMENT": "Entertainment",
    "INCOME": "Income",
    "HOME_IMPROVEMENT": "Housing",
    "RENT_AND_UTILITIES": "Utilities",
    "SHOPPING": "Shopping",
    "HEALTH_AND_WELLNESS": "Health",
    "SUBSCRIPTIONS": "Subscriptions",
}
OTHER = "Other"
INCOME = "Income"
UNKNOWN_MERCHANT = "Unknown"


def _category(code: Column, amount: Column) -> Column:
    pairs = [F.lit(text) for pair in CATEGORY_OF_CODE.items() for text in pair]
    label = F.coalesce(F.create_map(*pairs)[code], F.lit(OTHER))
    return F.when((code == "INCOME") | F.coalesce(amount < 0, F.lit(False)), INCOME).otherwise(label)


def normalize(feed: DataFrame) -> DataFrame:
    """One flat transaction per record. Row-local, so it also takes a streaming frame.

    A record without an amount counts 0; an amount that is no number stays unknown.
    """
    amount = F.when(F.col("amount").isNull(), F.lit(0)).otherwise(parse_amount(F.col("amount")))
    code = F.col("personal_finance_category.primary")
    merchant = F.nullif(F.col("merchant_name"), F.lit(""))
    return feed.select(
        parse_date(F.col("date")).alias("date"),
        F.coalesce(merchant, F.lit(UNKNOWN_MERCHANT)).alias("merchant"),
        _category(code, amount).alias("category"),
        F.abs(amount).cast(MONEY).alias("amount"),
    )
