"""A table of questions answered from a table of transactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.keywords import KNOWN_MERCHANTS
from tallymill.functions.money import spent_sentence
from tallymill.functions.windows import Starts, first_days, within
from tallymill.operators.grounding import ground_sets
from tallymill.operators.matching import ASK, CELL, SET, set_cells, window_cells, word_hits
from tallymill.operators.questions import (
    clean_questions,
    distinct_asks,
    parse_questions,
    windows_asked,
)
from tallymill.operators.skew import balanced_join
from tallymill.operators.summary import TOP_MERCHANTS, category_breakdown
from tallymill.operators.summary import top_merchants, totals
from tallymill.operators.trace import latency_lines
from tallymill.session import discard, materialize
from tallymill.sources.evaluations import append_evaluations

TOTALS = ("total_spend", "total_income", "net", "transaction_count")


@dataclass(frozen=True)
class AnswerBook:
    """Everything the summaries of a question table are read from.

    ``txns`` are the transactions that lie in any window asked for. ``asked`` holds each
    distinct ask once with its set, ``cells`` is the transactions table reduced to window,
    category and merchant, and ``kept`` are the cells each set keeps. These three are
    written to the shared folder: the big table is read once however many summaries are
    asked for, and later joins know the sizes of their sides.
    """

    txns: DataFrame
    starts: Starts
    parsed: DataFrame
    asked: DataFrame
    cells: DataFrame
    kept: DataFrame

    @classmethod
    def open(
        cls,
        questions: DataFrame,
        txns: DataFrame,
        known: Sequence[str] = KNOWN_MERCHANTS,
        weight: str | None = None,
    ) -> AnswerBook:
        """``weight`` names a column that says how many transactions a row stands for."""
        parsed = parse_questions(questions, known)
        starts = first_days(txns)
        asks = materialize(distinct_asks(parsed), "asks")
        windows = windows_asked(asks)
        cells = materialize(window_cells(txns, starts, windows, weight), "cells")
        hits = word_hits(asks, cells)
        kept = materialize(set_cells(hits, cells), "kept")
        return cls(within(txns, windows, starts), starts, parsed, hits.asks, cells, kept)

    def close(self) -> None:
        """Delete the stored tables, once no result is read from them any more."""
        for table in (self.asked, self.cells, self.kept):
            discard(table)

    def of_sets(self, keys: Sequence[str]) -> DataFrame:
        """Sums of what each set keeps, by ``keys`` at least."""
        return self.kept

    def of_windows(self, keys: Sequence[str]) -> DataFrame:
        """Sums of whole windows, by ``keys`` at least."""
        return self.cells

    def sets(self) -> DataFrame:
        """Distinct (hits, window) with totals, answer and whether any row was matched."""
        matched = totals(self.of_sets(["category"]), SET).withColumn("matched", F.lit(True))
        whole = totals(self.of_windows(["category"]), ["window"]).withColumnsRenamed(
            {name: f"window_{name}" for name in TOTALS}
        )
        if self.starts:  # at most one row per window name, nine in all
            whole = F.broadcast(whole)
        chosen = [
            F.when(F.col("matched"), F.col(name))
            .otherwise(F.coalesce(F.col(f"window_{name}"), F.lit(0)))
            .alias(name)
            for name in TOTALS
        ]
        return (
            self.asked.select(*SET)
            .distinct()
            .join(matched, SET, "left")
            .withColumn("matched", F.coalesce("matched", F.lit(False)))
            .join(whole, "window", "left")
            .select(*SET, "matched", *chosen)
            .withColumn("answer", spent_sentence(F.col("total_spend"), F.col("transaction_count")))
        )

    def _to_questions(self, by_set: DataFrame) -> DataFrame:
        """Back from sets to questions; a set may be that of most questions."""
        asked = self.parsed.select("question_id", "query", *ASK)
        of_set = asked.join(self.asked.drop("words"), ASK)
        return of_set.join(by_set, SET).drop("hits", "window")

    def _unmatched(self) -> DataFrame:
        """Sets that stand for their whole window: no keywords, or none matched."""
        sets = self.asked.select(*SET).distinct()
        return sets.join(self.kept.select(*SET).distinct(), SET, "left_anti")

    def _per_question(self, of_kept: DataFrame, of_window: DataFrame) -> DataFrame:
        by_window_set = self._unmatched().join(of_window, "window")
        by_set = materialize(of_kept.unionByName(by_window_set), "by-set")
        asked = self.parsed.select("question_id", *ASK).join(self.asked.drop("words"), ASK)
        return balanced_join(asked, by_set, SET).drop("hits", *ASK)

    def _with_fallback(self, by_question: DataFrame) -> DataFrame:
        fallback = ~F.col("matched") & (F.col("needle") != "")
        return by_question.withColumn("used_fallback", fallback).drop("matched", "needle")

    def summaries(self) -> DataFrame:
        """One row per question, also for questions without any row or text."""
        return self._with_fallback(self._to_questions(self.sets().drop("answer")))

    def category_breakdown(self) -> DataFrame:
        """(question_id, category, spend, rank)."""
        return self._per_question(
            category_breakdown(self.of_sets(["category"]), SET),
            category_breakdown(self.of_windows(["category"]), ["window"]),
        )

    def top_merchants(self, k: int = TOP_MERCHANTS) -> DataFrame:
        """(question_id, merchant, spend, rank) with rank up to k."""
        return self._per_question(
            top_merchants(self.of_sets(CELL), SET, k),
            top_merchants(self.of_windows(CELL), ["window"], k),
        )

    def answers(self) -> DataFrame:
        """(question_id, query, answer)."""
        return self._to_questions(self.sets().select(*SET, "answer")).drop("needle")

    def evaluated(self, mode: str = "exact") -> DataFrame:
        """Answers with their totals and the verdict of the grounding check.

        For the named windows only: the check relies on all of them ending on the newest date.
        """
        if not self.starts:
            raise ValueError("answers about other stretches of days are not checked")
        sets = materialize(self.sets(), "answered")
        checked = ground_sets(sets, self.kept, self.txns, self.starts, mode)
        return self._with_fallback(self._to_questions(checked))


def evaluation_records(evaluated: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Evaluated answers in the shape of the evaluation log.

    ``lines`` are latency lines of traces named after their questions.
    """
    if lines is None:
        return evaluated.select("query", "answer", "passed", "reason")
    named = lines.select(F.col("trace_id").alias("question_id"), "latency")
    timed = evaluated.join(named, "question_id", "left")
    return timed.select("query", "answer", "latency", "passed", "reason")


def answer_and_log(
    questions: DataFrame,
    txns: DataFrame,
    log_path: str,
    known: Sequence[str] = KNOWN_MERCHANTS,
    mode: str = "exact",
    trace: DataFrame | None = None,
    run: str | None = None,
) -> DataFrame:
    """Answer all questions, append their evaluations to the log, return the answers.

    ``run`` names the questions: if they are answered again under that name, as after a
    failure, the log keeps the records it has.

    ``trace`` holds the steps of answering, named after the questions; its latency lines
    go to the log.
    """
    book = AnswerBook.open(clean_questions(questions), txns, known)
    evaluated = materialize(book.evaluated(mode), "evaluated")
    lines = None if trace is None else latency_lines(trace)
    append_evaluations(evaluation_records(evaluated, lines), log_path, run)
    book.close()
    return evaluated


def responses(evaluated: DataFrame, trips: DataFrame) -> DataFrame:
    """(question_id, answer, latency_ms, grounded) with latencies from round_trips.

    ``trips`` holds one row per trace, and a trace is named after its question.
    """
    latency = F.floor(F.round(F.col("seconds") * 1000, 3)).alias("latency_ms")
    timed = trips.select(F.col("trace_id").alias("question_id"), latency)
    return evaluated.join(timed, "question_id", "left").select(
        "question_id", "answer", "latency_ms", F.col("passed").alias("grounded")
    )
