"""Questions about explicit stretches of days, answered from sums of nodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.keywords import KNOWN_MERCHANTS
from tallymill.operators.matching import ASK, CELL, SET, pairs_of_hits, word_hits
from tallymill.operators.questions import parse_questions
from tallymill.operators.ranges import (
    NODE,
    day_cells,
    days_of,
    node_cells,
    nodes_of_ranges,
    top_level,
)
from tallymill.operators.skew import balanced_join
from tallymill.plans.answers import AnswerBook
from tallymill.session import discard, materialize


@dataclass(frozen=True)
class RangeBook(AnswerBook):
    """An :class:`AnswerBook` whose windows are ranges of days, named by their bounds.

    ``nodes`` (window, level, node) are those of each range. ``cells`` holds the sums of each node,
    ``by_hits`` those of the pairs that a list of hits keeps, and ``kept`` the sets that keep any.
    Sums of a node are first brought down to what is asked for, and then added up per range.
    """

    nodes: DataFrame
    by_hits: DataFrame

    def close(self) -> None:
        for table in (self.asked, self.nodes, self.cells, self.by_hits, self.kept):
            discard(table)

    def of_sets(self, keys: Sequence[str]) -> DataFrame:
        sums = _summed(self.by_hits, ["hits", *NODE, *keys])
        in_nodes = self.kept.join(self.nodes, "window").join(sums, ["hits", *NODE])
        return _summed(in_nodes, [*SET, *keys])

    def of_windows(self, keys: Sequence[str]) -> DataFrame:
        """Of the ranges that some set needs as a whole."""
        needed = self._unmatched().select("window").distinct()
        in_nodes = self.nodes.join(needed, "window", "left_semi")
        return _summed(in_nodes.join(_summed(self.cells, [*NODE, *keys]), NODE), ["window", *keys])


def _summed(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.sum("amount").alias("amount"), F.sum("rows").alias("rows"))


def open_ranges(
    questions: DataFrame,
    txns: DataFrame,
    known: Sequence[str] = KNOWN_MERCHANTS,
    weight: str | None = None,
) -> RangeBook:
    """The book of questions(question_id, query, first_day, last_day).

    Their days count, not the words of a window that a text may have. A bound that is null is
    open; rows of unknown date belong to questions without any bound. Otherwise keywords, fallback
    and summaries are those of :class:`AnswerBook`, but for the grounding check.

    The transactions are read once and become sums per day and pair, and these sums per node
    in use. A set of keywords meets the nodes of all its ranges at once, and each range then
    adds up what stands in its nodes.
    """
    day = {name: F.col(name).cast("date") for name in ("first_day", "last_day")}
    named = questions.select(
        F.struct("question_id", *[day[name].alias(name) for name in day]).alias("question_id"), "query"
    )
    bounds = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in day]
    parsed = (
        parse_questions(named, known)
        .drop("window")
        .select("question_id.*", "query", "keywords", "merchant_keywords", "needle")
        .withColumn("window", F.concat_ws("/", *bounds))
    )
    asks = materialize(
        parsed.select(*ASK, "keywords", "merchant_keywords", *day).distinct(), "asks"
    )
    daily = materialize(day_cells(txns, weight), "day-cells")
    days = days_of(daily)
    ranges = asks.select("window", *day).distinct()
    nodes = materialize(nodes_of_ranges(ranges, days), "nodes")
    summed = materialize(node_cells(daily, nodes, top_level(days)), "node-cells")
    hits = word_hits(asks, daily)

    sets = hits.asks.filter("hits != ''").select(*SET).distinct()
    met = materialize(pairs_of_hits(hits, daily), "hit-pairs")
    wanted = sets.join(nodes, "window").select("hits", *NODE).distinct()
    of_hits = balanced_join(summed, met, CELL).join(wanted, ["hits", *NODE])
    by_hits = materialize(of_hits, "hit-nodes")
    some = by_hits.select("hits", *NODE).distinct()
    kept = materialize(sets.join(nodes, "window").join(some, ["hits", *NODE]).select(*SET).distinct(), "kept")
    for table in (asks, daily, met):
        discard(table)
    return RangeBook(txns, {}, parsed, hits.asks, summed, kept, nodes, by_hits)
