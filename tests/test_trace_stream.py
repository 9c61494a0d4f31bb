import datetime as dt
import random

import pandas as pd
import pyarrow as pa
import pytest

from tallymill.operators.trace import step_durations
from tallymill.streaming.trace import WAITING, duration_store, durations, late_steps
from tallymill.streaming.trace import numbered_steps, write_durations

START = dt.datetime(2024, 1, 1)
SCHEMA = "trace_id string, seq long, step string, ts timestamp"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def arrive(spark, tmp_path):
    """Writes a file of steps and takes in all files that have arrived."""
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    count = iter(range(1000))

    def run(*batches):
        for steps in batches:
            file = str(folder / f"{next(count):04d}")
            spark.createDataFrame(steps, SCHEMA).coalesce(1).write.json(file)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/*")
        query = write_durations(durations(stream, "30 minutes"), target, str(tmp_path / "state"))
        query.awaitTermination(300)
        rows = duration_store(spark, target).read().collect()
        return query, sorted((r.trace_id, r.position, r.seq, r.step, r.ts, r.seconds) for r in rows if r.trace_id != "end")

    return run


END = [[("end", 0, "x", at(9000))], [("end", 1, "x", at(9001))]]


def test_shuffled_arrival_equals_the_batch(spark, arrive):
    chance = random.Random(2)
    steps = [(f"t{n % 4}", n, f"s{n % 3}", at(chance.randrange(200))) for n in range(300)]
    steps += [("t1", 900, "tie", at(50)), ("t1", 901, "tie", at(50)), ("t0", 902, "no time", None)]
    # No step is more than the delay behind another that arrives before it.
    arrival = sorted(steps, key=lambda s: (s[3] or START) + dt.timedelta(minutes=chance.randrange(30)))
    query, found = arrive(*[arrival[k : k + 60] for k in range(0, len(arrival), 60)], *END)
    batch = step_durations(spark.createDataFrame(steps, SCHEMA)).collect()
    assert found == sorted((r.trace_id, r.position, r.seq, r.step, r.ts, r.seconds) for r in batch)
    assert late_steps(query) == 0


def test_late_steps_are_counted(arrive):
    first = [[("t", 1, "a", at(0)), ("t", 2, "b", at(100))], [("t", 3, "c", at(101))]]
    query, found = arrive(*first)
    assert [row[2] for row in found] == [1]
    query, found = arrive([("t", 4, "late", at(5)), ("t", 5, "in time", at(90))], *END)
    assert late_steps(query) == 1
    assert [(row[1], row[2], row[5]) for row in found] == [
        (1, 1, None), (2, 5, 5400.0), (3, 2, 600.0), (4, 3, 60.0),
    ]


def test_traces_that_share_a_state(spark, arrive, monkeypatch):
    monkeypatch.setattr("tallymill.streaming.trace.BUCKETS", 2)
    chance = random.Random(4)
    steps = [(f"t{n % 40}", n, f"s{n % 3}", at(n // 4)) for n in range(400)]
    arrival = sorted(steps, key=lambda s: s[3] + dt.timedelta(minutes=chance.randrange(25)))
    _, found = arrive(*[arrival[k : k + 100] for k in range(0, 400, 100)], *END)
    batch = step_durations(spark.createDataFrame(steps, SCHEMA)).collect()
    assert found == sorted((r.trace_id, r.position, r.seq, r.step, r.ts, r.seconds) for r in batch)


def test_steps_are_numbered_on_from_the_last_of_their_trace():
    rows = {"trace_id": ["b", "a", "b", None], "at": [7, 5, 6, 9], "seq": [1, 2, 3, 4], "step": ["x", None, "y", "z"]}
    last = {"b": (3, 4), "c": (1, 1)}
    found = numbered_steps(pa.table(rows, WAITING), last)
    assert found[["seq", "position"]].values.tolist() == [[2, 1], [3, 4], [1, 5], [4, 1]]
    assert [None if pd.isna(x) else x for x in found["micros"]] == [None, 2, 1, None]
    assert last == {"b": (5, 7), "c": (1, 1), "a": (1, 5), None: (1, 9)}
