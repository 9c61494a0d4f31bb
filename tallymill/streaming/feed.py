"""Bank feed as a stream of files, with the rules of the batch feed.

Each micro-batch is read as the batch feed is: texts that cannot be read become rejects and
never transactions. Transactions and rejects go to versioned tables, under the number of
the batch, so a batch that Spark repeats after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymill.operators.normalize import normalize
from tallymill.schemas import REJECT
from tallymill.session import discard, materialize
from tallymill.sources.feed import payload_parts, record_parts, records_in, rejects_in
from tallymill.sources.snapshots import Snapshots
from tallymill.sources.transactions import synced_store

Batch = Callable[[DataFrame, int], None]


def stream_texts(
    spark: SparkSession, folder: str, multi_line: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """(body): the lines of files as they arrive, or whole files with ``multi_line``."""
    reader = spark.readStream.format("text").option("wholetext", multi_line)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(F.col("value").alias("body"))


def rejects_store(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, REJECT)


def batch_sync(
    path: str, rejects: str, source: str, payloads: bool = True, replace: bool = False
) -> Batch:
    """What to do with a micro-batch: transactions to ``path``, what is wrong to ``rejects``.

    A batch extends both tables, or with ``replace`` becomes both, as each sync of the batch
    feed does. The texts are parsed once and stored until both tables are written. The rejects
    go first; if the run ends between the two, the repeated batch finds them there.
    """
    parts_of = payload_parts if payloads else record_parts

    def run(texts: DataFrame, batch: int) -> None:
        spark = texts.sparkSession
        parts = materialize(parts_of(texts, F.col("body")), "feed-batch")
        found = [(rejects_store(spark, rejects), rejects_in(parts))]
        found.append((synced_store(spark, path), normalize(records_in(parts))))
        for store, rows in found:
            (store.replace if replace else store.append)(rows, source, batch)
        discard(parts)

    return run


def sync_stream(
    texts: DataFrame,
    path: str,
    rejects: str,
    checkpoint: str,
    payloads: bool = True,
    replace: bool = False,
) -> StreamingQuery:
    """Take in what has arrived, then stop.

    The checkpoint names the source: its batches are numbered in it. ``payloads`` says whether
    a text is a response payload or a record.
    """
    run = batch_sync(path, rejects, checkpoint, payloads, replace)
    return (
        texts.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
