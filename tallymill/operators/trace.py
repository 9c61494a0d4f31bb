"""Step durations of ordered traces.

A trace may be very long, so no step is computed over a whole trace at once. Steps are
dealt out by ranges of trace and time and looked at per (trace, range); one row for each
carries position and time over.

Steps without a time have no place in a trace. They are left out, of all counts as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.latency import round_trip_text, seconds_between, step_text
from tallymill.session import materialize

#: Steps whose texts are put together in one task before the whole line is.
STEPS_PER_PIECE = 1_000


def _timed(trace: DataFrame) -> DataFrame:
    return trace.filter(F.col("ts").isNotNull())


def _in_stretches(trace: DataFrame) -> DataFrame:
    """Steps with the number of their stretch.

    The steps of all traces are dealt out by ranges of trace and time. A stretch is what one
    range holds of a trace, so the steps of one second, or of one moment, may be several.
    """
    order = ["trace_id", "ts", "seq", F.xxhash64(*trace.columns)]
    dealt = _timed(trace).repartitionByRange(*order).withColumn("stretch", F.spark_partition_id())
    return materialize(dealt, "stretches")


def step_durations(trace: DataFrame) -> DataFrame:
    """Add position (from 1) and seconds since the previous step.

    trace(trace_id, seq, step, ts) is ordered by time and then ``seq``; the first step of a
    trace has no duration.
    """
    steps = _in_stretches(trace)
    key = ["trace_id", "stretch"]
    # Steps that are equal in time and number are ordered as they were dealt out.
    inside = Window.partitionBy(*key).orderBy("ts", "seq", F.xxhash64(*trace.columns))
    numbered = steps.withColumn("at", F.row_number().over(inside)).withColumn(
        "previous", F.lag("ts").over(inside)
    )
    earlier = Window.partitionBy("trace_id").orderBy("stretch")
    carried = (
        steps.groupBy(*key)
        .agg(F.count("*").alias("steps"), F.max("ts").alias("last"))
        .select(
            *key,
            F.coalesce(
                F.sum("steps").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
            F.lag("last").over(earlier).alias("carried"),
        )
    )
    previous = F.coalesce("previous", "carried")
    return numbered.join(carried, key).select(
        *trace.columns,
        (F.col("before") + F.col("at")).alias("position"),
        seconds_between(previous, F.col("ts")).alias("seconds"),
    )


def round_trips(trace: DataFrame) -> DataFrame:
    """(trace_id, steps, seconds) from first to last step; single steps are left out."""
    return (
        _timed(trace)
        .groupBy("trace_id")
        .agg(
            F.count("*").alias("steps"),
            seconds_between(F.min("ts"), F.max("ts")).alias("seconds"),
        )
        .filter(F.col("steps") > 1)
    )


def _joined(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(*by, text): the texts of a group in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    texts: Column = F.transform("parts", lambda part: part["text"])
    return rows.groupBy(*by).agg(parts.alias("parts")).select(
        *by, F.array_join(texts, " | ").alias("text")
    )


def latency_lines(trace: DataFrame, steps_per_piece: int = STEPS_PER_PIECE) -> DataFrame:
    """(trace_id, latency): the round trip and all steps of a trace as one text.

    Texts are joined in pieces first, so a task sorts pieces, not steps, of a long trace.
    """
    timed = step_durations(trace).filter(F.col("seconds").isNotNull())
    pieces = timed.select(
        "trace_id",
        F.floor(F.col("position") / F.lit(steps_per_piece)).alias("piece"),
        "position",
        step_text(F.col("step"), F.col("seconds")).alias("text"),
    )
    lines = _joined(_joined(pieces, ["trace_id", "piece"], "position"), ["trace_id"], "piece")
    return lines.join(round_trips(trace), "trace_id").select(
        "trace_id",
        F.concat_ws(" | ", round_trip_text(F.col("seconds")), "text").alias("latency"),
    )
