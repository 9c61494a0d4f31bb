"""Relative date windows, all anchored at the newest date in the data."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases, in the order in which they are tried.
PHRASES = (
    "last month",
    "this month",
    "last week",
    "this week",
    "last year",
    "this year",
    "today",
    "yesterday",
)
ALL_TIME = "all"
WINDOWS = (*PHRASES, ALL_TIME)

Starts = dict[str, datetime.date | None]

# First day of each window, given the newest date. Every window ends on that date.
_FIRST_DAY: dict[str, Callable[[Column], Column]] = {
    "last month": lambda newest: F.add_months(newest, -1),
    "this month": lambda newest: F.trunc(newest, "MM"),
    "last week": lambda newest: F.date_sub(newest, 7),
    "this week": lambda newest: F.trunc(newest, "week"),
    "last year": lambda newest: F.add_months(newest, -12),
    "this year": lambda newest: F.trunc(newest, "YEAR"),
    "today": lambda newest: newest,
    "yesterday": lambda newest: F.date_sub(newest, 1),
}


def window_of(query: Column) -> Column:
    """Name of the window a question asks for: the first phrase it contains."""
    text = F.lower(query)
    found = F.when(text.contains(PHRASES[0]), PHRASES[0])
    for phrase in PHRASES[1:]:
        found = found.when(text.contains(phrase), phrase)
    return found.otherwise(ALL_TIME)


def first_days(txns: DataFrame) -> Starts:
    """First day of every phrase window; unknown for a table without dates.

    Reads one value, the newest date of the whole table. Windows are literals from then
    on: they reach the file scan and no later step has to look at the table for them.
    """
    newest = txns.agg(F.max("date").alias("newest"))
    days = [day(F.col("newest")).alias(phrase) for phrase, day in _FIRST_DAY.items()]
    return newest.select(*days).first().asDict()


def _day(starts: Starts, phrase: str) -> Column:
    return F.lit(starts[phrase]).cast("date")


def in_window(date: Column, window: str, starts: Starts) -> Column:
    """Whether a date lies in a named window; an unknown date lies only in "all"."""
    if window == ALL_TIME:
        return F.lit(True)
    return date >= _day(starts, window)


def start_of(window: Column, starts: Starts) -> Column:
    """First day for a window name held in a column; null for "all"."""
    chosen = F.when(window == PHRASES[0], _day(starts, PHRASES[0]))
    for phrase in PHRASES[1:]:
        chosen = chosen.when(window == phrase, _day(starts, phrase))
    return chosen


def within(txns: DataFrame, windows: Sequence[str], starts: Starts) -> DataFrame:
    """Rows that lie in any of the windows: one bound on the date, for the file scan."""
    if ALL_TIME in windows:
        return txns
    days = [starts[window] for window in windows if starts[window] is not None]
    return txns.filter(F.col("date") >= F.lit(min(days, default=None)).cast("date"))


def windows_with(date: Column, starts: Starts) -> Column:
    """Names of all windows a date lies in."""
    return F.array_compact(
        F.array(*[F.when(in_window(date, w, starts), F.lit(w)) for w in WINDOWS])
    )


def stretch_of(date: Column, starts: Starts) -> Column:
    """Number of the stretch of time a date lies in.

    The first days cut time into at most nine stretches. All windows end on the same
    day, so a window is made of whole stretches: its own first one and all later ones.
    """
    stretch = F.lit(0)
    for number, day in enumerate(_cuts(starts), start=1):
        stretch = F.when(date >= F.lit(day), number).otherwise(stretch)
    return stretch


def windows_of_stretches(
    starts: Starts, windows: Sequence[str] = WINDOWS
) -> list[list[str]]:
    """Names of those windows that contain each stretch, by stretch number."""
    cuts = _cuts(starts)

    def contains(window: str, number: int) -> bool:
        if window == ALL_TIME:
            return True
        day = starts[window]
        return day is not None and cuts.index(day) < number

    return [
        [window for window in windows if contains(window, number)]
        for number in range(len(cuts) + 1)
    ]


def _cuts(starts: Starts) -> list[datetime.date]:
    return sorted({day for day in starts.values() if day is not None})
