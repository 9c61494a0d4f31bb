"""Totals, category breakdown and top merchants.

All three take any frame with ``category``, ``merchant`` and ``amount``. A ``rows``
column, if present, says how many transactions a row stands for; without it each row
is one transaction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.money import is_income

TOP_MERCHANTS = 5


def _weight(df: DataFrame) -> Column:
    return F.col("rows") if "rows" in df.columns else F.lit(1).cast("long")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _sum(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0))


def totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total_spend, total_income, net and the number of expense rows."""
    income = is_income(F.col("category"))
    amount = F.col("amount")
    spend, earned = _sum(F.when(~income, amount)), _sum(F.when(income, amount))
    expenses = F.coalesce(F.sum(F.when(~income, _weight(df))), F.lit(0))
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(
        spend.alias("total_spend"),
        earned.alias("total_income"),
        (earned - spend).alias("net"),
        expenses.cast("long").alias("transaction_count"),
    )


def _spend(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    expenses = df.filter(~is_income(F.col("category")))
    return expenses.groupBy(*by, _text(key).alias(key)).agg(_sum(F.col("amount")).alias("spend"))


def _ranked(spend: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("spend"), F.asc(key))
    return spend.withColumn("rank", F.row_number().over(order))


def category_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expenses per category with their rank, largest first; ties by name."""
    return _ranked(_spend(df, by, "category"), by, "category")


def top_merchants(
    df: DataFrame, by: Sequence[str] = (), k: int = TOP_MERCHANTS
) -> DataFrame:
    """The k merchants with the largest expenses and their rank; ties by name."""
    spend = _spend(df, by, "merchant")
    return _ranked(spend, by, "merchant").filter(F.col("rank") <= k)
