"""Raw bank feed: nested records under the key ``transactions``.

Whatever cannot be read is reported, never turned into a transaction: a text that is not a
JSON object of the expected shape is rejected as a whole, and a record whose amount is no
number is reported beside its transaction of unknown amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.money import parse_amount
from tallymill.schemas import FEED, FEED_PAYLOAD

BROKEN = "not a JSON object of the expected shape"
NO_NUMBER = "the amount is not a number"


def parsed_json(body: Column, schema: T.StructType) -> Column:
    """Struct of a JSON text with ``_broken``: the text itself unless it was read in full."""
    with_broken = T.StructType([*schema.fields]).add("_broken", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return F.from_json(body, with_broken, options)


def texts(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """(body): the lines that are not blank, or whole files with ``multi_line``."""
    found = spark.read.text(path, wholetext=multi_line).select(F.col("value").alias("body"))
    return found.filter(F.length(F.trim("body")) > 0)


def _read(df: DataFrame, body: Column, schema: T.StructType) -> DataFrame:
    """(body, parsed, ok); a text without content is no record."""
    found = df.select(body.alias("body")).filter(F.length(F.trim("body")) > 0)
    read = found.withColumn("parsed", parsed_json(F.col("body"), schema))
    shaped = F.col("body").rlike(r"^\s*\{")
    return read.withColumn("ok", shaped & F.col("parsed._broken").isNull())


def _exploded(read: DataFrame, records: Column) -> DataFrame:
    """(body, ok, record): a row for each record, and one with null where there is none.

    The outer form keeps the optimiser from testing the list below the explosion, where it
    would parse each text a second time.
    """
    listed = F.when(F.col("ok"), records)
    return read.select("body", "ok", F.explode_outer(listed).alias("record"))


def payload_parts(df: DataFrame, payload: Column) -> DataFrame:
    """(body, ok, record) of response payloads: records, and texts that could not be read."""
    return _exploded(_read(df, payload, FEED_PAYLOAD), F.col("parsed.transactions"))


def record_parts(df: DataFrame, body: Column) -> DataFrame:
    """As :func:`payload_parts`, of texts that are one record each."""
    record = F.struct(*[F.col(f"parsed.{name}") for name in FEED.names])
    return _exploded(_read(df, body, FEED), F.array(record))


def records_in(parts: DataFrame) -> DataFrame:
    return parts.filter("record IS NOT NULL").select("record.*")


def rejects_in(parts: DataFrame) -> DataFrame:
    """(text, reason): broken texts, and records whose amount is no number."""
    wrong = F.col("record.amount").isNotNull() & parse_amount(F.col("record.amount")).isNull()
    return parts.filter(~F.col("ok") | wrong).select(
        F.when(F.col("ok"), F.to_json("record")).otherwise(F.col("body")).alias("text"),
        F.when(F.col("ok"), NO_NUMBER).otherwise(BROKEN).alias("reason"),
    )


def records_of(df: DataFrame, payload: Column) -> DataFrame:
    """Feed records from a text column of response payloads; none if the key is absent."""
    return records_in(payload_parts(df, payload))


def rejects_of(df: DataFrame, payload: Column) -> DataFrame:
    """(text, reason): what :func:`records_of` could not read."""
    return rejects_in(payload_parts(df, payload))


def read_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Feed records from JSON, one record per line, or per file with ``multi_line``."""
    return records_in(record_parts(texts(spark, path, multi_line), F.col("body")))


def feed_rejects(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(text, reason): what :func:`read_feed` could not read."""
    return rejects_in(record_parts(texts(spark, path, multi_line), F.col("body")))


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Feed records from response payloads, one per line, or per file with ``multi_line``."""
    return records_of(texts(spark, path, multi_line), F.col("body"))


def payload_rejects(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(text, reason): what :func:`read_payloads` could not read."""
    return rejects_of(texts(spark, path, multi_line), F.col("body"))
