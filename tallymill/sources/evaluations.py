"""Evaluation log: JSON lines in parts that are committed as a whole.

Each append is a part of a versioned table. The log is what its newest version lists, so the
lines of an append that failed are in no log, and an append that is repeated under the same
name is there once. JSON files that stand beside the parts, such as older logs, are read too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.schemas import EVALUATION
from tallymill.sources.feed import parsed_json, texts
from tallymill.sources.snapshots import MOST_PARTS, Snapshots, Version


def evaluation_log(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, EVALUATION, kind="json")


def append_evaluations(
    records: DataFrame,
    path: str,
    run: str | None = None,
    batch: int = 0,
    most_parts: int = MOST_PARTS,
) -> Version:
    """Add records to the log.

    ``run`` names what is logged, and ``batch`` numbers its appends: one that is repeated, as
    after a failure, changes nothing. Without a name each call adds its records. Many small
    parts are rewritten as one.
    """
    columns = [
        F.col(field.name).cast(field.dataType)
        if field.name in records.columns
        else F.lit(None).cast(field.dataType).alias(field.name)
        for field in EVALUATION
    ]
    log = evaluation_log(records.sparkSession, path)
    log.append(records.select(*columns), run, None if run is None else batch)
    return log.compact(most_parts)


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    log = evaluation_log(spark, path)
    folders = [f"{log.folder}/parts/{name}" for name in log.current().parts]
    if any(name.endswith(".json") for name in log.files.names(log.folder)):
        folders.append(log.folder)  # only the files directly in it
    if not folders:
        lines = spark.createDataFrame([], "body string")
    else:
        lines = texts(spark, folders, multi_line=False)
    return lines.withColumn("record", parsed_json(F.col("body"), EVALUATION)).withColumn(
        "ok", F.col("body").rlike(r"^\s*\{") & F.col("record._broken").isNull()
    )


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """All whole records; blank lines are skipped and older records may lack fields."""
    return _parsed(spark, path).filter("ok").select(*[f"record.{n}" for n in EVALUATION.names])


def broken_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """(body): lines of the log that are no record."""
    return _parsed(spark, path).filter("NOT ok").select("body")
