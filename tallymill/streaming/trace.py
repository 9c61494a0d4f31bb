"""Step durations of traces that arrive out of order.

Steps wait in the state until the watermark has passed their time: from then on no step before
them is accepted, so position and duration are final. What arrives within the watermark's
delay, in any order, gives the rows of the batch form. A step behind the watermark is dropped
by Spark and counted. The state holds the steps of one delay, and one row of each trace.

Traces share states, ``BUCKETS`` in all, by a hash of their names. What a batch brings for a
state is kept, and later looked at, as one table: calls and state accesses grow with batches
and buckets, not with traces and steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymill.functions.latency import micros_to_seconds
from tallymill.sources.snapshots import Snapshots

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: States that the traces are dealt out to.
BUCKETS = 1_024

#: Steps as their durations are found: ``micros`` is the time since the step before.
NUMBERED = "trace_id string, seq long, step string, at long, position long, micros long"
DURATION = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("step", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("position", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


WAITING = pa.schema(
    [("trace_id", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("step", pa.string())]
)
LAST = pa.schema([("trace_id", pa.string()), ("position", pa.int64()), ("at", pa.int64())])


def packed(table: pa.Table) -> bytearray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return bytearray(sink.getvalue())


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def numbered_steps(due: pa.Table, last: dict) -> pd.DataFrame:
    """Position and time since the step before of steps that come next in their traces.

    ``last`` holds position and time of the last step of each trace, and is brought up to date.
    """
    rows = due.sort_by([(name, "ascending") for name in WAITING.names])
    traces = rows.column("trace_id").combine_chunks().dictionary_encode("encode")
    codes, at = traces.indices.to_numpy(), rows.column("at").to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    ends = np.concatenate((starts[1:], [len(codes)]))
    names = traces.dictionary.take(pa.array(codes[starts])).to_pylist()
    before = [last.get(name, (0, None)) for name in names]
    bases = np.array([position for position, _ in before])
    positions = np.arange(len(codes)) + np.repeat(bases - starts + 1, ends - starts)
    micros = pd.Series(np.diff(at, prepend=at[:1]), dtype="Int64")
    micros.iloc[starts] = [
        pd.NA if known is None else int(at[start]) - known for start, (_, known) in zip(starts, before)
    ]
    for name, end in zip(names, ends):
        last[name] = (int(positions[end - 1]), int(at[end - 1]))
    found = {name: rows.column(name).to_pandas() for name in ("trace_id", "seq", "step", "at")}
    return pd.DataFrame({**found, "position": positions, "micros": micros})


class InOrder(StatefulProcessor):
    """Gives the steps of the traces of a bucket in order, once none can come before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "steps binary")
        self.last = handle.getValueState("last", "steps binary")
        self.timer = handle.getValueState("timer", "due long")

    def _wake(self, at: int) -> None:
        """Ask to be called when the watermark passes a time, unless it is sooner already."""
        due = -(-at // 1000)
        known = self.timer.get() if self.timer.exists() else None
        if known is None or due < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                steps = pa.Table.from_pandas(batch[WAITING.names], WAITING, preserve_index=False)
                self.waiting.appendValue((packed(steps),))
                self._wake(int(batch["at"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        steps = pa.concat_tables([unpacked(data) for data, in self.waiting.get()])
        is_due = pc.less_equal(steps.column("at"), passed)
        due, rest = steps.filter(is_due), steps.filter(pc.invert(is_due))
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(packed(rest),)])
            self._wake(pc.min(rest.column("at")).as_py())
        if not len(due):
            return
        known = unpacked(self.last.get()[0]).to_pylist() if self.last.exists() else []
        last = {row["trace_id"]: (row["position"], row["at"]) for row in known}
        yield numbered_steps(due, last)
        rows = [(name, *told) for name, told in last.items()]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), LAST.types)]
        self.last.update((packed(pa.table(columns, LAST)),))

    def close(self) -> None:
        pass


def durations(trace: DataFrame, delay: str) -> DataFrame:
    """DURATION rows of a stream trace(trace_id, seq, step, ts); ``delay`` as in "2 hours"."""
    trace.sparkSession.conf.set(PROVIDER, ROCKS)
    known = trace.filter("ts IS NOT NULL").withWatermark("ts", delay)
    steps = known.select(
        F.col("trace_id").cast("string").alias("trace_id"), F.col("seq").cast("long").alias("seq"),
        "step", "ts", F.unix_micros("ts").alias("at"),
    )
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).alias("bucket")
    numbered = steps.select("*", bucket).groupBy("bucket").transformWithStateInPandas(
        InOrder(), NUMBERED, outputMode="append", timeMode="EventTime"
    )
    return numbered.select(
        "trace_id",
        "seq",
        "step",
        F.timestamp_micros("at").alias("ts"),
        "position",
        micros_to_seconds(F.col("micros")).alias("seconds"),
    )


def duration_store(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, DURATION)


def write_durations(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the durations of what has arrived to a versioned table, then stop.

    Batches are numbered in the checkpoint, so one that is repeated is there once.
    """

    def run(rows: DataFrame, batch: int) -> None:
        duration_store(rows.sparkSession, path).append(rows, checkpoint, batch)

    return (
        found.writeStream.foreachBatch(run)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_steps(query: StreamingQuery) -> int:
    """Steps of a run that came behind the watermark."""
    states = [state for progress in query.recentProgress for state in progress["stateOperators"]]
    return sum(state["numRowsDroppedByWatermark"] for state in states)
