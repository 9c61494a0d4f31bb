"""Spending reports: periods compared, trends, shares, recurring charges, spikes, rules.

Each report first sums to one row per group and day or month, so the windows that follow
run over calendar-sized groups however many transactions a group holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.money import is_income
from tallymill.functions.windows import first_days

# Text in a merchant name or description and the category it implies.
MERCHANT_RULES = {
    "starbucks": "Dining",
    "uber": "Transportation",
    "amazon": "Shopping",
    "phone": "Utilities",
    "internet": "Utilities",
    "water": "Utilities",
    "electricity": "Utilities",
    "ride-share": "Transportation",
    "train": "Transportation",
    "bus": "Transportation",
    "fuel": "Transportation",
}

# Days between charges that count as a regular schedule.
MONTHLY = (26, 35)
YEARLY = (351, 380)
REGULAR_SHARE = 0.8
FEWEST_CHARGES = 3

#: Charges of a merchant count as usual up to this share of those of the months before.
HISTORY_MONTHS = 12
USUAL_SHARE = 0.99
FEWEST_BEFORE = 20
SKETCH_K = 200

SPIKE_MONTHS = 3
SPIKE_DEVIATIONS = 2.0


def _expenses(txns: DataFrame) -> DataFrame:
    return txns.filter(~is_income(F.col("category")))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _sum(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0))


def compare_periods(txns: DataFrame) -> DataFrame:
    """Spend per category this month and last month up to the same day, and the change.

    The newest date of the table is today. If last month is too short to have that day, it
    counts as a whole.
    """
    starts = first_days(txns)
    today, first, same_day = starts["today"], starts["this month"], starts["last month"]
    day = F.lit(first).cast("date")
    last = F.col("date").between(F.add_months(day, -1), F.lit(same_day).cast("date"))
    this = F.col("date").between(day, F.lit(today).cast("date"))

    def spend(within: Column) -> Column:
        return _sum(F.when(within, F.col("amount")))

    recent = _expenses(txns).filter(this | last)
    return recent.groupBy(_text("category").alias("category")).agg(
        spend(this).alias("this_month"),
        spend(last).alias("last_month"),
        (spend(this) - spend(last)).alias("change"),
    )


def monthly_spend(txns: DataFrame, key: str) -> DataFrame:
    """(key, month, spend) of expenses with a known date."""
    dated = _expenses(txns).filter(F.col("date").isNotNull())
    month = F.trunc(F.col("date"), "MM").alias("month")
    return dated.groupBy(_text(key).alias(key), month).agg(_sum(F.col("amount")).alias("spend"))


def monthly_trend(txns: DataFrame) -> DataFrame:
    """Spend per category and month with the change from the month before it in the data."""
    spend = monthly_spend(txns, "category")
    earlier = F.lag("spend").over(Window.partitionBy("category").orderBy("month"))
    return spend.withColumn("change", F.col("spend") - earlier)


def merchant_share(txns: DataFrame) -> DataFrame:
    """Spend per merchant and its share of all spend."""
    expenses = _expenses(txns)
    whole = expenses.agg(F.sum("amount")).scalar()
    spend = expenses.groupBy(_text("merchant").alias("merchant")).agg(
        _sum(F.col("amount")).alias("spend")
    )
    share = F.try_divide(F.col("spend").cast("double"), whole.cast("double"))
    return spend.withColumn("share", share)


def recurring_merchants(txns: DataFrame) -> DataFrame:
    """Merchants by the days between their charges, and whether these keep a schedule.

    A merchant is recurring when most gaps between its charge days are a month, or a
    year, long.
    """
    days = (
        _expenses(txns)
        .filter(F.col("date").isNotNull())
        .groupBy(_text("merchant").alias("merchant"), "date")
        .agg(_sum(F.col("amount")).alias("spend"))
    )
    before = F.lag("date").over(Window.partitionBy("merchant").orderBy("date"))
    gap = F.col("gap")
    counted = (
        days.withColumn("gap", F.datediff("date", before))
        .groupBy("merchant")
        .agg(
            F.count("*").alias("charge_days"),
            F.sum("spend").alias("spend"),
            F.count("gap").alias("gaps"),
            F.count_if(gap.between(*MONTHLY)).alias("monthly_gaps"),
            F.count_if(gap.between(*YEARLY)).alias("yearly_gaps"),
        )
    )

    def regular(gaps: str) -> Column:
        enough = F.col("charge_days") >= FEWEST_CHARGES
        return enough & (F.col(gaps) >= F.col("gaps") * F.lit(REGULAR_SHARE))

    schedule = F.when(regular("monthly_gaps"), "monthly").when(regular("yearly_gaps"), "yearly")
    return counted.withColumn("schedule", schedule)


def spend_spikes(txns: DataFrame) -> DataFrame:
    """Months in which a category costs far more than in the months before.

    The base is mean and deviation of the previous three months that have spend.
    """
    by_category = Window.partitionBy("category").orderBy("month")
    base = by_category.rowsBetween(-SPIKE_MONTHS, -1)
    spend = F.col("spend").cast("double")
    measured = monthly_spend(txns, "category").select(
        "category",
        "month",
        "spend",
        F.avg(spend).over(base).alias("usual"),
        F.stddev_samp(spend).over(base).alias("deviation"),
    )
    limit = F.col("usual") + F.col("deviation") * F.lit(SPIKE_DEVIATIONS)
    return measured.withColumn("is_spike", F.coalesce(spend > limit, F.lit(False)))


def charge_sketches(txns: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(merchant, month, charges, sketch): quantile sketches of a merchant's charges by month.

    Sketches can be merged: those of new transactions join stored ones of the same month.
    """
    charges = _expenses(txns).filter("date IS NOT NULL AND amount IS NOT NULL")
    return charges.groupBy(
        _text("merchant").alias("merchant"), F.trunc("date", "MM").alias("month")
    ).agg(
        F.count("*").alias("charges"),
        F.kll_sketch_agg_double(F.col("amount").cast("double"), F.lit(k)).alias("sketch"),
    )


def usual_limits(
    sketches: DataFrame,
    months: int = HISTORY_MONTHS,
    share: float = USUAL_SHARE,
    k: int = SKETCH_K,
) -> DataFrame:
    """(merchant, month, history, usual_limit): what ``share`` of earlier charges stay below.

    The history of a month is the ``months`` before it. Each sketch goes to the months that it
    is history of and is merged there, so no step sees the charges of a merchant as one group.
    """
    later = F.explode(F.sequence(F.add_months("month", 1), F.add_months("month", months), F.expr("INTERVAL 1 MONTH")))
    merged = (
        sketches.select("merchant", later.alias("month"), "charges", "sketch")
        .groupBy("merchant", "month")
        .agg(F.sum("charges").alias("history"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    )
    limit = F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    return merged.select("merchant", "month", "history", limit.alias("usual_limit"))


def unusual_charges(
    txns: DataFrame,
    months: int = HISTORY_MONTHS,
    share: float = USUAL_SHARE,
    fewest: int = FEWEST_BEFORE,
    k: int = SKETCH_K,
) -> DataFrame:
    """Charges above what ``share`` of the merchant's charges of the months before stay below.

    Adds history and usual_limit. Months with a history of fewer than ``fewest`` charges have no
    usual. The limit is a quantile up to the sketch's error in rank, under 2 % with the default;
    sketches draw at random, so limits of two runs may differ by as much.
    """
    limits = usual_limits(charge_sketches(txns, k), months, share, k).filter(F.col("history") >= fewest)
    keyed = _expenses(txns).select(
        "*", _text("merchant").alias("_merchant"), F.trunc("date", "MM").alias("_month")
    )
    named = limits.withColumnsRenamed({"merchant": "_merchant", "month": "_month"})
    found = keyed.join(named, ["_merchant", "_month"]).drop("_merchant", "_month")
    return found.filter(F.col("amount").cast("double") > F.col("usual_limit"))


def rule_category(text: Column, rules: Mapping[str, str] = MERCHANT_RULES) -> Column:
    """Category of the first rule whose text occurs as whole words, ignoring case.

    Null without any. A word ends where letters and digits do.
    """
    lowered = F.lower(text)
    found = F.lit(None).cast("string")
    for needle, category in reversed(rules.items()):
        word = rf"(?<![\p{{L}}\p{{N}}])\Q{needle.lower()}\E(?![\p{{L}}\p{{N}}])"
        found = F.when(lowered.rlike(word), category).otherwise(found)
    return found


def rule_categorize(txns: DataFrame, rules: Mapping[str, str] = MERCHANT_RULES) -> DataFrame:
    """Transactions with the category their merchant implies, where a rule applies."""
    implied = rule_category(F.col("merchant"), rules)
    return txns.withColumn("rule_category", F.coalesce(implied, F.col("category")))
