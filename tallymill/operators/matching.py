"""Transactions that answer a question.

A question keeps the rows in its window whose category or merchant contains one of its
keywords. If no row is kept, it falls back to all rows in the window.

Everything a question tests depends on (date, category, merchant) only. The fact table
is therefore reduced once to one cell per (category, merchant) and window; questions
meet cells, never rows, and the number of cells does not grow with the number of rows.

Most words of most questions occur in no category or merchant. Each distinct word meets the
values once; questions with the same words that do occur, and the same window, have the same
answer: they share a set. Whatever follows is computed once per set.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.keywords import KNOWN_MERCHANTS, MIN_LENGTH, keywords
from tallymill.functions.keywords import matches, merchant_keywords
from tallymill.functions.windows import (
    ALL_TIME,
    WINDOWS,
    Starts,
    first_days,
    start_of,
    stretch_of,
    window_of,
    windows_of_stretches,
    windows_with,
    within,
)
from tallymill.operators.questions import distinct_asks, parse_questions, windows_asked
from tallymill.operators.skew import balanced_join, key_sizes, listing_join
from tallymill.session import materialize

LONGEST_GRAM = 6
ASK = ["needle", "window"]
SET = ["hits", "window"]
CELL = ["category", "merchant"]


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def window_cells(
    txns: DataFrame, starts: Starts, windows: Sequence[str] = WINDOWS, weight: str | None = None
) -> DataFrame:
    """(window, category, merchant, amount, rows) of those windows a pair has rows in.

    ``weight`` names a column that says how many transactions a row stands for.

    One pass over date, category, merchant and amount. Rows are first summed per stretch
    of time, map-side too, so a pair that holds most of the rows is a few rows per task
    before the shuffle. Windows are then put together from stretches.
    """
    stretches = within(txns, windows, starts).groupBy(
        _filled("category").alias("category"),
        _filled("merchant").alias("merchant"),
        stretch_of(F.col("date"), starts).alias("stretch"),
    ).agg(
        F.sum("amount").alias("amount"),
        (F.sum(weight) if weight else F.count("*")).alias("rows"),
    )
    names = F.array(
        *[
            F.array(*[F.lit(w) for w in some]).cast("array<string>")
            for some in windows_of_stretches(starts, windows)
        ]
    )
    in_windows = F.explode(F.get(names, F.col("stretch"))).alias("window")
    return (
        stretches.select(in_windows, *CELL, "amount", "rows")
        .groupBy("window", *CELL)
        .agg(
            F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"),
            F.sum("rows").alias("rows"),
        )
    )


def _with_grams(values: DataFrame) -> DataFrame:
    """(side, value, text, gram): every letter sequence of a value that a gram can equal.

    The gram of a keyword is its first ``LONGEST_GRAM`` letters, or the whole keyword if
    it is shorter. It occurs in a text exactly if it is the head of one of its tails.
    """
    texts = values.withColumn("text", F.lower("value")).filter(F.length("text") >= MIN_LENGTH)
    at = F.explode(F.sequence(F.lit(1), F.length("text") - (MIN_LENGTH - 1)))
    tail = F.substr("text", F.col("at"), F.lit(LONGEST_GRAM))
    heads = [F.left(tail, F.lit(size)) for size in range(MIN_LENGTH, LONGEST_GRAM + 1)]
    grams = texts.withColumn("at", at).select(
        "side",
        "value",
        "text",
        F.length(tail).alias("longest"),
        F.posexplode(F.array(*heads)).alias("number", "gram"),
    )
    return grams.filter(F.col("number") + MIN_LENGTH <= F.col("longest")).select(
        "side", "value", "text", "gram"
    )


def _sided(side: str, words: str) -> Column:
    """A list of words as (side, word)."""
    return F.transform(words, lambda word: F.struct(F.lit(side).alias("side"), word.alias("word")))


def _sides() -> Column:
    """Category and merchant of a cell as (side, value)."""
    pairs = [F.struct(F.lit(side).alias("side"), F.col(side).alias("value")) for side in CELL]
    return F.array(*pairs)


@dataclass(frozen=True)
class WordHits:
    """Which words occur in which values, and the sets that asks come down to.

    ``found`` (side, word, value): side is ``category`` or ``merchant``. ``asks`` are the
    distinct asks with ``words``, their (side, word) that occur somewhere, and ``hits``,
    these as one text; it is empty if there are none.
    """

    found: DataFrame
    asks: DataFrame


def word_hits(asks: DataFrame, cells: DataFrame) -> WordHits:
    """Each distinct word meets each distinct value once.

    An equi-join on grams finds the candidates and ``contains`` confirms words that are
    longer than a gram.
    """
    sided = F.concat(_sided("category", "keywords"), _sided("merchant", "merchant_keywords"))
    words = asks.select("needle", F.explode(sided).alias("of")).select("needle", "of.*").distinct()
    values = cells.select(F.explode(_sides()).alias("of")).select("of.*").distinct()
    gram = F.substring("word", 1, LONGEST_GRAM).alias("gram")
    wanted = materialize(words.select("side", "word", gram).distinct(), "wanted")
    # A gram may begin very many words and occur in very many values.
    candidates = balanced_join(materialize(_with_grams(values), "grams"), wanted, ["side", "gram"])
    confirmed = candidates.filter(F.contains("text", F.col("word")))
    found = materialize(confirmed.select("side", "word", "value").distinct(), "word-hits")

    key = ["side", "word"]
    hitting = words.join(found.select(*key).distinct(), key, "left_semi")
    lists = hitting.groupBy("needle").agg(
        F.array_sort(F.collect_list(F.struct(*key))).alias("words")
    )
    text = F.transform("words", lambda of: F.concat_ws(":", of["side"], of["word"]))
    resolved = asks.select(*ASK).join(lists, "needle", "left")
    hits = F.coalesce(F.array_join(text, " "), F.lit("")).alias("hits")
    return WordHits(found, materialize(resolved.select(*ASK, hits, "words"), "resolved"))


def _set_values(hits: WordHits, by: Sequence[str]) -> DataFrame:
    """(*by, side, value): what the words of the sets occur in."""
    sets = hits.asks.filter("hits != ''").select(*by, "words").distinct()
    words = sets.select(*by, F.explode("words").alias("of")).select(*by, "of.*")
    # A word may be that of very many sets and occur in very many values.
    met = balanced_join(materialize(words, "set-words"), hits.found, ["side", "word"])
    return materialize(met.select(*by, "side", "value").distinct(), "set-values")


def pairs_of_hits(hits: WordHits, cells: DataFrame) -> DataFrame:
    """(hits, category, merchant): the pairs that each list of hits keeps, in any window."""
    values = _set_values(hits, ["hits"])
    pairs = cells.select(*CELL).distinct()
    by_side = materialize(pairs.select(*CELL, F.explode(_sides()).alias("of")).select(*CELL, "of.*"), "pairs")
    return balanced_join(by_side, values, ["side", "value"]).select("hits", *CELL).distinct()


def set_cells(hits: WordHits, cells: DataFrame) -> DataFrame:
    """(hits, window, category, merchant, amount, rows): the cells each set keeps.

    A cell is looked up by its category and by its merchant; found twice it counts once.
    """
    values = _set_values(hits, SET)
    by_side = cells.select("*", F.explode(_sides()).alias("of")).select(*cells.columns, "of.*")
    found = balanced_join(by_side, values, ["window", "side", "value"])
    return found.dropDuplicates([*SET, *CELL]).select(*SET, *CELL, "amount", "rows")


@dataclass(frozen=True)
class Matches:
    """Rows that answer questions, each set of equal answers once.

    ``members``: (question_id, used_fallback, hits, window), a row for each question.
    ``rows``: hits, window and the columns of the transactions. A set without hits is its
    whole window. ``sizes``: (hits, window, rows), how many rows there are of each.
    """

    members: DataFrame
    rows: DataFrame
    sizes: DataFrame

    def of_questions(self, wanted: DataFrame | None = None) -> DataFrame:
        """The rows of each question, or of those in ``wanted`` (question_id).

        Every question gets all of its rows, so the result is as large as it says. The rows of a
        question come one after the other, part by part, which a sum per question gains from.
        """
        members = self.members
        if wanted is not None:
            members = members.join(wanted.select("question_id").distinct(), "question_id", "left_semi")
        members = materialize(members, "members")
        joined = listing_join(members, self.rows, SET, key_sizes(members, SET), self.sizes)
        return joined.select(
            "question_id", "used_fallback", *[c for c in self.rows.columns if c not in SET]
        )


def matching_transactions(
    questions: DataFrame, txns: DataFrame, known: Sequence[str] = KNOWN_MERCHANTS
) -> Matches:
    """The rows that answer each question; ``used_fallback`` if no keyword was found."""
    parsed = parse_questions(questions, known)
    starts = first_days(txns)
    asks = materialize(distinct_asks(parsed), "asks")
    windows = windows_asked(asks)
    cells = materialize(window_cells(txns, starts, windows), "cells")
    hits = word_hits(asks, cells)
    kept = materialize(set_cells(hits, cells).select(*SET, *CELL, "rows"), "kept")

    matched = kept.select(*SET).distinct().withColumn("matched", F.lit(True))
    answered = hits.asks.join(matched, SET, "left").select(
        *ASK,
        F.when(F.col("matched"), F.col("hits")).otherwise("").alias("hits"),
        (F.col("matched").isNull() & (F.col("needle") != "")).alias("used_fallback"),
    )
    # Stored, so that Spark sees which side is small: all questions of an ask at once are too many.
    answered = materialize(answered, "answered")
    members = parsed.select("question_id", *ASK).join(answered, ASK)

    row = F.struct(*[F.col(name) for name in txns.columns]).alias("txn")
    dated = within(txns, windows, starts)
    keyed = dated.select(
        row,
        F.col("date").alias("_date"),
        _filled("category").alias("category"),
        _filled("merchant").alias("merchant"),
    )
    start = start_of(F.col("window"), starts)
    pair_sizes = cells.groupBy(*CELL).agg(F.max("rows").alias("rows"))
    of_sets = kept.select(*SET, *CELL)
    hit_rows = balanced_join(keyed, of_sets, CELL, left_sizes=pair_sizes).filter(
        (F.col("window") == ALL_TIME) | (F.col("_date") >= start)
    )
    needed = answered.filter("hits = ''").agg(F.collect_set("window")).scalar()
    lies_in = F.array_intersect(windows_with(F.col("date"), starts), needed)
    window_rows = dated.select(F.lit("").alias("hits"), F.explode(lies_in).alias("window"), row)
    rows = hit_rows.select(*SET, "txn").unionByName(window_rows).select(*SET, "txn.*")
    whole = cells.groupBy(F.lit("").alias("hits"), "window").agg(F.sum("rows").alias("rows"))
    sizes = kept.groupBy(*SET).agg(F.sum("rows").alias("rows")).unionByName(whole)
    members = members.select("question_id", "used_fallback", *SET)
    return Matches(members, rows, materialize(sizes, "set-sizes"))


def transactions_for(
    query: str, txns: DataFrame, known: Sequence[str] = KNOWN_MERCHANTS
) -> DataFrame:
    """Rows that answer one question, plus ``used_fallback``.

    No join and no shuffle: one scan sees whether anything matches, another returns the
    rows, both with the date bound pushed down.
    """
    text = F.lit(query)
    words = keywords(text)
    window, found, merchant_found = (
        txns.sparkSession.range(1)
        .select(window_of(text), words, merchant_keywords(words, known))
        .first()
    )
    inside = txns
    if window != ALL_TIME:
        inside = within(txns, [window], first_days(txns))
    if not found:
        return inside.withColumn("used_fallback", F.lit(False))

    def any_of(column: str, wanted: Sequence[str]) -> Column:
        return matches(F.col(column), F.array(*[F.lit(word) for word in wanted]))

    hit = any_of("category", found) | any_of("merchant", merchant_found)
    any_hit = F.coalesce(inside.agg(F.max(hit)).scalar(), F.lit(False))
    return inside.filter(hit | ~any_hit).withColumn("used_fallback", ~any_hit)


def newest_first(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows by date, newest first, unknown dates last; all columns break ties."""
    rest = [F.asc(name) for name in sorted(rows.columns) if name not in ("date", *by)]
    return rows.orderBy(*by, F.desc_nulls_last("date"), *rest)

