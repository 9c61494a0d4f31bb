"""Quality rules per document, and per host with rates shrunk by an empirical beta prior.

A host is a value of a column such as the domain or the source. Documents that break a
rule are counted per host. The rate of a small host says little, so it is drawn towards
the rates of all hosts: a beta distribution is fitted to the host rates by their mean and
variance, and a host's rate is the mean of its posterior. Documents of a host whose shrunk
rate is above a limit are rejected with the host.

Defined cases: a null text has no words and fails the rule on words. A null host is no host;
its documents are judged alone. Equal rows are judged alike and each keeps its row. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import map_slices, text_udf, utf8
from tallymill.session import discard, materialize

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long"
)


@dataclass(frozen=True)
class Limits:
    """A document fails a rule beyond these; a host is rejected above ``host_rate``."""

    least_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 30
    dup_line_percent: int = 30
    host_rate: float = 0.5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; windows are compared by 64-bit hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    values = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = np.zeros(n, np.uint64)
    for at in range(window):
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes += values[at : at + n]
        hashes ^= hashes >> np.uint64(29)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(hashes, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    text = text or b""
    words = text.split()
    inside = text.translate(None, SPACE)
    # Bytes 10xxxxxx continue a character.
    marks = np.frombuffer(inside, np.uint8)
    chars = len(inside) - int(((marks & 0xC0) == 0x80).sum())
    symbols = len(inside) - len(inside.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        chars,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(
    docs: DataFrame, host: str = "source", text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """(host, row, measures): ``row`` is a struct of the carried columns, by default all."""
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns])
    source = docs.select(
        F.col(text).alias("text"), F.col(host).alias("host"), carried.alias("row")
    )
    fields = StructType.fromDDL(MEASURES).fields
    schema = StructType([source.schema["host"], source.schema["row"], *fields])
    names = [field.name for field in fields]

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measure(value) for value in utf8(batch.column("text"))]
            columns = zip(*found) if found else [[] for _ in names]
            arrays = [pa.array(column, pa.int64()) for column in columns]
            kept = [batch.column("host"), batch.column("row")]
            return pa.record_batch([*kept, *arrays], ["host", "row", *names])

        return work

    return map_slices(source, schema, factory)


def failed_base(limits: Limits) -> Column:
    return (F.col("n_words") < limits.least_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")
    )


def failed_any(limits: Limits) -> Column:
    """What counts against the host: the base rules, symbols and repeated lines."""
    return (
        failed_base(limits)
        | (100 * F.col("n_symbols") > limits.symbol_percent * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > limits.dup_line_percent * F.col("n_lines"))
    )


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate) from failures(host, failed).

    The prior comes from the unweighted mean and variance of the host rates. Where these
    leave no beta distribution (one host, equal rates), the prior weighs as one document.
    """
    hosts = (
        failures.filter("host IS NOT NULL")
        .groupBy("host")
        .agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    mean = 0.0 if mean is None else mean
    weight = mean * (1 - mean) / spread - 1 if spread else 1.0
    weight = weight if weight > 0 else 1.0
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("shrunk_rate", shrunk)


def judge(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    carry: Sequence[str] | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """(host, row, measures, host_rate, base_failed, kept), a row for each row of ``docs``.

    The measured rows are stored once: the hosts are counted from them, and the verdicts
    join them.
    """
    rows = materialize(measured(docs, host, text, carry), "quality")
    return _verdicts(rows, _stored_rates(rows, limits), limits)


def _stored_rates(rows: DataFrame, limits: Limits) -> DataFrame:
    """Rates per host as a stored table, so that Spark knows how few they are."""
    return materialize(host_rates(rows.select("host", failed_any(limits).alias("failed"))), "hosts")


def _verdicts(rows: DataFrame, rates: DataFrame, limits: Limits) -> DataFrame:
    """Only the hosts cross the network while their table is small; else Spark splits the
    rows of a crowded host."""
    found = rows.join(
        rates.select("host", F.col("shrunk_rate").alias("host_rate")), "host", "left"
    )
    fair = F.coalesce(F.col("host_rate") <= limits.host_rate, F.lit(True))
    return found.withColumn("base_failed", failed_base(limits)).withColumn(
        "kept", ~F.col("base_failed") & fair
    )


def keep_good(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that neither fail a base rule nor come from a rejected host.

    The texts are measured twice instead of being stored with their measures. Only they go to
    Python, and only measures come back.
    """
    measures = text_udf(lambda texts: list(map(measure, texts)), MEASURES)
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    found = docs.select(F.col(host).alias("host"), whole.alias("row"), measures(F.col("text")).alias("found"))
    rows = found.select("host", "row", "found.*")
    narrow = materialize(rows.drop("row"), "quality")
    rates = _stored_rates(narrow, limits)
    discard(narrow)
    return _verdicts(rows, rates, limits).filter("kept").select("row.*")
