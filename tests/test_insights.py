import datetime as dt
import random
from decimal import Decimal

import pytest

from tallymill.operators import insights

DAY = dt.date


def txns(spark, rows):
    full = [(d, Decimal(str(a)), c, m) for d, a, c, m in rows]
    schema = "date date, amount decimal(18,2), category string, merchant string"
    return spark.createDataFrame(full, schema)


def test_compare_periods(spark):
    df = txns(
        spark,
        [
            (DAY(2024, 3, 15), 10, "A", "m"),
            (DAY(2024, 3, 1), 5, "A", "m"),
            (DAY(2024, 2, 15), 7, "A", "m"),
            (DAY(2024, 2, 16), 1000, "A", "m"),
            (DAY(2024, 2, 1), 2, "A", "m"),
            (DAY(2024, 1, 31), 1000, "A", "m"),
            (DAY(2024, 3, 2), 9, "Income", "m"),
            (DAY(2024, 2, 10), 3, None, "m"),
            (DAY(2024, 2, 20), 3, "B", "m"),
        ],
    )
    rows = {r.category: tuple(r)[1:] for r in insights.compare_periods(df).collect()}
    assert rows == {"A": (15, 9, 6), "": (0, 3, -3)}


def test_unusual_charges(spark):
    """Limits lie within the sketch's error in rank of the exact quantile."""
    chance = random.Random(5)
    rows = []
    for n in range(6000):
        day = DAY(2022, 1, 1) + dt.timedelta(chance.randrange(900))
        rows.append((day, round(chance.lognormvariate(3, 1), 2), "A", ["m", "n", None][n % 3]))
    rows += [(DAY(2023, 5, 5), 99_999, "A", "m"), (DAY(2023, 5, 5), 99_999, "Income", "m")]
    rows += [(DAY(2023, 5, 1), 5, "A", "rare"), (DAY(2023, 6, 1), 500, "A", "rare")]
    df = txns(spark, rows)
    limits = {(r.merchant, r.month): r for r in insights.usual_limits(insights.charge_sketches(df)).collect()}
    flagged = {tuple(r)[:4] for r in insights.unusual_charges(df).collect()}
    assert (DAY(2023, 5, 5), Decimal("99999.00"), "A", "m") in flagged
    assert not any(c == "Income" or m == "rare" for _, _, c, m in flagged)
    for (merchant, month), row in limits.items():
        first = DAY(month.year - 1, month.month, 1)
        before = [a for d, a, c, m in rows if c == "A" and (m or "") == merchant and first <= d < month]
        assert row.history == len(before)
        below = sum(a <= row.usual_limit for a in before) / len(before)
        strictly = sum(a < row.usual_limit for a in before) / len(before)
        assert strictly <= 0.99 + 0.02 and below >= 0.99 - 0.02
        # Sketches draw at random where they halve, so limits differ a little between runs.
        for d, a, c, m in rows:
            if c == "A" and (m or "") == merchant and d.replace(day=1) == month and len(before) >= 20:
                is_flagged = (d, Decimal(str(a)).quantize(Decimal("0.01")), c, m) in flagged
                assert is_flagged or a <= max(before)
                assert not is_flagged or sum(b < a for b in before) >= 0.97 * len(before)


def test_sketches_of_batches_merge(spark):
    rows = [(DAY(2024, 1, 1 + n % 28), n, "A", "m") for n in range(1, 3000)]
    halves = [insights.charge_sketches(txns(spark, rows[at::2])) for at in range(2)]
    (row,) = insights.usual_limits(halves[0].unionByName(halves[1]), months=1).collect()
    assert row.history == 2999 and abs(row.usual_limit - 2970) < 0.02 * 3000


def test_a_short_last_month_counts_whole(spark):
    df = txns(spark, [(DAY(2024, 3, 31), 10, "A", "m"), (DAY(2024, 2, 29), 4, "A", "m")])
    assert [tuple(r)[1:] for r in insights.compare_periods(df).collect()] == [(10, 4, 6)]


def test_trend_and_spikes(spark):
    spends = [100, 101, 99, 100, 500, 100]
    df = txns(spark, [(DAY(2024, n + 1, 5), s, "A", "m") for n, s in enumerate(spends)])
    trend = insights.monthly_trend(df).orderBy("month").collect()
    assert [r.change for r in trend] == [None, 1, -2, 1, 400, -400]
    spikes = insights.spend_spikes(df).orderBy("month").collect()
    assert [r.is_spike for r in spikes] == [False, False, False, False, True, False]


def test_merchant_share(spark):
    rows = [(None, 30, "A", "x"), (None, 10, "A", "y"), (None, 99, "Income", "z")]
    shares = {r.merchant: r.share for r in insights.merchant_share(txns(spark, rows)).collect()}
    assert shares == {"x": pytest.approx(0.75), "y": pytest.approx(0.25)}


def test_recurring_merchants(spark):
    rows = [(DAY(2024, n, 3), 9.99, "S", "monthly") for n in range(1, 8)]
    rows += [(DAY(2019 + n, 3, 3), 99, "S", "yearly") for n in range(4)]
    rows += [(DAY(2024, 1, n), 5, "S", "daily") for n in range(1, 20)]
    rows += [(DAY(2024, 1, 1), 5, "S", "once"), (DAY(2024, 2, 1), 5, "S", "twice")]
    rows += [(DAY(2024, 3, 1), 5, "S", "twice")]
    found = {r.merchant: r.schedule for r in insights.recurring_merchants(txns(spark, rows)).collect()}
    assert found == {"monthly": "monthly", "yearly": "yearly", "daily": None, "once": None, "twice": None}


def test_rules(spark):
    names = ["STARBUCKS #1", "Uber Eats", "amazon", "City Water", "Ride-Share Co", "Other", None]
    df = txns(spark, [(None, 1, "given", name) for name in names])
    found = [r.rule_category for r in insights.rule_categorize(df).collect()]
    assert found == [
        "Dining", "Transportation", "Shopping", "Utilities", "Transportation", "given", "given",
    ]
