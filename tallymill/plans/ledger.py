"""Totals that are kept up to date batch by batch, without reading old transactions again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.keywords import KNOWN_MERCHANTS
from tallymill.operators.ranges import day_cells
from tallymill.plans.answers import AnswerBook
from tallymill.plans.ranges import RangeBook, open_ranges
from tallymill.schemas import DAY_CELL
from tallymill.sources.snapshots import MOST_PARTS, Snapshots, Version

WEIGHT = "rows"


def _by_date(cells: DataFrame, path: str) -> None:
    ordered = cells.repartitionByRange("date", "category", "merchant").sortWithinPartitions("date")
    ordered.write.parquet(path)


class Ledger:
    """Sums per day, category and merchant of all batches so far.

    A batch is reduced to such sums and added to a versioned table as a part of its own; the sums
    of a day may stand in several parts. Every total is made of them: windows end on the newest
    date there is by then, so each batch may move them. Parts are merged when there are many.

    Batches are numbered by their source. A batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Snapshots(spark, path, DAY_CELL, write=_by_date)

    def add(self, txns: DataFrame, source: str, batch: int, most_parts: int = MOST_PARTS) -> Version:
        """Take in a batch; only its own rows are read, and now and then sums are merged."""
        self.store.append(day_cells(txns), source, batch)
        return self.store.compact(most_parts, lambda cells: day_cells(cells, WEIGHT))

    def cells(self) -> DataFrame:
        """(date, category, merchant, amount, rows) of the newest version."""
        return self.store.read()

    def newest(self):
        """The date on which the windows end."""
        return self.cells().agg(F.max("date")).first()[0]

    def book(self, questions: DataFrame, known: Sequence[str] = KNOWN_MERCHANTS) -> AnswerBook:
        """Answers to questions about the usual windows."""
        return AnswerBook.open(questions, self.cells(), known, WEIGHT)

    def range_book(self, questions: DataFrame, known: Sequence[str] = KNOWN_MERCHANTS) -> RangeBook:
        """Answers to questions about stretches of days of their own."""
        return open_ranges(questions, self.cells(), known, WEIGHT)
