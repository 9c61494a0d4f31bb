"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    app: str = "tallymill", master: str | None = None, **extra: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tallymill-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, below the shared folder."""
    return f"{shared_folder(spark)}/tallymill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several later steps start from one result, so that it is computed once
    and survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let the shuffle files of each query that runs inside go when the query ends.

    Otherwise they stay until the driver's garbage is collected. Tables that are stored inside
    do not need them; a table that is not stored would be computed again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`materialize` wrote, once nobody reads it."""
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/tallymill/"
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if _plain(own) not in _plain(folder):
            raise ValueError(f"{folder} is not a table of materialize()")
        _delete(spark, folder)


def discard_all(spark: SparkSession) -> None:
    """Delete every intermediate table below the shared folder, of all sessions."""
    _delete(spark, f"{shared_folder(spark)}/tallymill")


def bound_arrow_batches(spark: SparkSession, rows: int) -> None:
    """Let batches that go to Python hold at most so many rows, from now on in this session.

    Where rows hold long texts, Spark's 10,000 of them take much memory on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def _plain(path: str) -> str:
    return path.replace("file://", "file:").replace("file:", "")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
