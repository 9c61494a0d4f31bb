"""Latency lines: ``round_trip=1.200s | step: 0.700s | ...``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.text import find_all

# How the log writes a round trip and a step.
ROUND_TRIP_FORMAT = "round_trip=%.3fs"
STEP_FORMAT = "%s: %.3fs"
STEP = r"([^|:]+): (\d+\.\d{3})s"


def micros_to_seconds(micros: Column) -> Column:
    """Seconds to the millisecond."""
    return F.round(micros.cast("decimal(20,0)") / F.lit(1000000), 3).cast("double")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds between two timestamps, to the millisecond."""
    return micros_to_seconds(F.unix_micros(end) - F.unix_micros(start))


def step_text(step: Column, seconds: Column) -> Column:
    return F.format_string(STEP_FORMAT, step, seconds)


def round_trip_text(seconds: Column) -> Column:
    return F.format_string(ROUND_TRIP_FORMAT, seconds)


def round_trip_of(line: Column) -> Column:
    return F.regexp_extract(line, r"^round_trip=(\d+\.\d{3})s", 1).try_cast("double")


def steps_of(line: Column) -> Column:
    """Array of (step, seconds) read back from a latency line."""
    return F.transform(
        find_all(line, r"[^|:]+: \d+\.\d{3}s"),
        lambda part: F.struct(
            F.trim(F.regexp_extract(part, STEP, 1)).alias("step"),
            F.regexp_extract(part, STEP, 2).cast("double").alias("seconds"),
        ),
    )
