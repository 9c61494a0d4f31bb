import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymill.functions.windows import (
    WINDOWS,
    first_days,
    in_window,
    start_of,
    stretch_of,
    window_of,
    windows_of_stretches,
    windows_with,
    within,
)

DAY = dt.date


@pytest.mark.parametrize(
    "newest, expected",
    [
        (
            DAY(2024, 3, 31),
            {
                "last month": DAY(2024, 2, 29),
                "this month": DAY(2024, 3, 1),
                "last week": DAY(2024, 3, 24),
                "this week": DAY(2024, 3, 25),
                "last year": DAY(2023, 3, 31),
                "this year": DAY(2024, 1, 1),
                "today": DAY(2024, 3, 31),
                "yesterday": DAY(2024, 3, 30),
            },
        ),
        (
            DAY(2024, 2, 29),
            {
                "last month": DAY(2024, 1, 29),
                "this month": DAY(2024, 2, 1),
                "last week": DAY(2024, 2, 22),
                "this week": DAY(2024, 2, 26),
                "last year": DAY(2023, 2, 28),
                "this year": DAY(2024, 1, 1),
                "today": DAY(2024, 2, 29),
                "yesterday": DAY(2024, 2, 28),
            },
        ),
    ],
)
def test_first_days_hang_on_the_newest_date(spark, newest, expected):
    txns = spark.createDataFrame([(DAY(2020, 1, 1),), (newest,), (None,)], "date date")
    assert first_days(txns) == expected


def test_a_table_without_dates_has_empty_windows(spark):
    txns = spark.createDataFrame([(None,)], "date date")
    starts = first_days(txns)
    assert set(starts.values()) == {None}
    kept = {w: txns.filter(in_window(F.col("date"), w, starts)).count() for w in WINDOWS}
    assert kept == {w: int(w == "all") for w in WINDOWS}
    assert windows_of_stretches(starts) == [["all"]]
    assert within(txns, ["today"], starts).isEmpty()
    assert within(txns, ["today", "all"], starts).count() == 1


def test_first_phrase_in_order_wins(spark):
    questions = [
        ("compare this month vs LAST MONTH", "last month"),
        ("this month or this week", "this month"),
        ("yesterday and today", "today"),
        ("only yesterday", "yesterday"),
        ("in the last years", "last year"),
        ("last  month", "all"),
        ("", "all"),
    ]
    df = spark.createDataFrame(questions, "q string, expected string")
    assert df.filter(window_of(F.col("q")) != F.col("expected")).isEmpty()


def test_stretches_and_window_lists_agree_with_single_windows(spark):
    days = [(DAY(2024, 3, 31) - dt.timedelta(n),) for n in range(500)] + [(None,)]
    txns = spark.createDataFrame(days, "date date")
    starts = first_days(txns)
    date = F.col("date")
    for window in WINDOWS:
        inside = F.coalesce(in_window(date, window, starts), F.lit(False))
        number = [window in names for names in windows_of_stretches(starts)].index(True)
        by_stretch = stretch_of(date, starts) >= number
        by_list = F.array_contains(windows_with(date, starts), window)
        assert within(txns, [window], starts).count() == txns.filter(inside).count()
        start = start_of(F.lit(window), starts)
        by_start = F.coalesce(date >= start, F.lit(window == "all"))
        wrong = txns.filter((inside != by_stretch) | (inside != by_list) | (inside != by_start))
        assert wrong.isEmpty(), window
