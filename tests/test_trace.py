import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymill.functions.latency import round_trip_of, steps_of
from tallymill.operators.trace import _in_stretches, latency_lines, round_trips, step_durations

START = dt.datetime(2024, 1, 1, 10, 59, 59)


def trace(spark, rows):
    schema = "trace_id string, seq long, step string, ts timestamp"
    stamped = [(t, n, s, START + dt.timedelta(seconds=at)) for t, n, s, at in rows]
    return spark.createDataFrame(stamped, schema)


def test_one_trace_as_a_line(spark):
    steps = [("begin", 0.0), ("read", 0.25), ("add up", 0.375), ("write", 2.5), ("check", 4.0)]
    df = trace(spark, [("q", n, s, at) for n, (s, at) in enumerate(steps)])
    (line,) = latency_lines(df).collect()
    assert line.latency == (
        "round_trip=4.000s | read: 0.250s | add up: 0.125s | write: 2.125s | check: 1.500s"
    )
    text = spark.createDataFrame([(line.latency,), ("",), (None,)], "t string")
    parsed = text.select(round_trip_of(F.col("t")), steps_of(F.col("t"))).collect()
    assert parsed[0][0] == 4.0
    assert [tuple(s) for s in parsed[0][1]] == [
        ("read", 0.25), ("add up", 0.125), ("write", 2.125), ("check", 1.5),
    ]
    assert parsed[1][0] is None and parsed[1][1] == []


def test_fewer_than_two_steps_give_no_line(spark):
    df = trace(spark, [("one", 0, "start", 0.0)])
    assert latency_lines(df).isEmpty()
    assert round_trips(df).isEmpty()
    (row,) = step_durations(df).collect()
    assert (row.position, row.seconds) == (1, None)


def test_traces_across_buckets_equal_a_plain_walk(spark):
    rng = random.Random(5)
    rows = []
    for name, n in (("hot", 400), ("a", 30), ("b", 2), ("c", 1)):
        at = 0.0
        for number in range(n):
            at += rng.choice([0.0, 0.0005, 0.25, 1800.0, 9000.0])
            rows.append((name, number, f"s{rng.randrange(4)}", at))
    df = trace(spark, rows).repartition(5)
    for coalesced in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        got = {(r.trace_id, r.seq): r for r in step_durations(df).collect()}
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        last = {}
        for name, number, _, at in rows:
            row = got[name, number]
            assert row.position == number + 1
            if name in last:
                micros = round((at - last[name]) * 1e6)
                assert row.seconds == (micros + 500) // 1000 / 1000
            else:
                assert row.seconds is None
            last[name] = at


def test_very_many_steps_of_one_second_are_dealt_out(spark):
    """No task gets all steps of a second, or of a moment."""
    moment = F.lit(START).cast("timestamp")
    later = F.make_dt_interval(secs=F.col("id") % 3 * F.lit(0.1))
    rows = spark.range(100_000).select(
        F.lit("t").alias("trace_id"), F.col("id").alias("seq"), F.lit("s").alias("step"), (moment + later).alias("ts")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stretches = _in_stretches(rows)
        largest = stretches.groupBy("stretch").count().agg(F.max("count")).first()[0]
        found = step_durations(rows).agg(
            F.count("*"), F.max("position"), F.count_distinct("position"), F.sum("seconds"), F.count("seconds")
        )
        assert largest < 45_000
        assert tuple(found.first()) == (100_000, 100_000, 100_000, pytest.approx(0.2), 99_999)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_trace_is_one_whole_line(spark):
    df = trace(spark, [("t", n, f"s{n}", float(n)) for n in range(50)])
    (line,) = latency_lines(df, steps_per_piece=7).collect()
    assert line.latency == " | ".join(
        ["round_trip=49.000s", *[f"s{n}: 1.000s" for n in range(1, 50)]]
    )


def test_steps_without_a_time_count_nowhere(spark):
    known = trace(spark, [("t", 1, "a", 0.0), ("t", 3, "c", 2.0)])
    lost = spark.createDataFrame([("t", 2, "b", None), ("u", 1, "x", None)], known.schema)
    both = known.unionByName(lost)
    got = sorted((r.seq, r.position, r.seconds) for r in step_durations(both).collect())
    assert got == [(1, 1, None), (3, 2, 2.0)]
    assert [(r.trace_id, r.steps, r.seconds) for r in round_trips(both).collect()] == [("t", 2, 2.0)]
    assert [r.latency for r in latency_lines(both).collect()] == ["round_trip=2.000s | c: 2.000s"]
