"""Are all numbers of an answer found in its evidence?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.money import amount_text
from tallymill.functions.text import number_tokens
from tallymill.functions.windows import ALL_TIME, Starts, start_of
from tallymill.operators.matching import CELL, SET
from tallymill.operators.skew import balanced_join
from tallymill.session import materialize

# Fixed value: the reason given for an unsupported number.
NOT_FOUND = "Answer contains numbers not found in retrieved data."
FOUND = "Every number in the answer occurs in the retrieved data."


def evidence_text(txns: DataFrame) -> Column:
    """A transaction as a JSON record with ISO dates and plain amounts."""
    as_text = {
        "date": F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"),
        "amount": amount_text(F.col("amount")),
    }
    fields = [as_text.get(name, F.col(name)).alias(name) for name in txns.columns]
    return F.to_json(F.struct(*fields))


def _verdict(answers: DataFrame, missing: DataFrame, by: list[str]) -> DataFrame:
    """Add passed, unsupported and reason; an answer without numbers passes."""
    unsupported = missing.groupBy(*by).agg(
        F.array_sort(F.collect_list("token")).alias("unsupported")
    )
    passed = F.col("unsupported").isNull()
    return (
        answers.join(unsupported, by, "left")
        .withColumn("passed", passed)
        .withColumn("reason", F.when(passed, FOUND).otherwise(NOT_FOUND))
        .withColumn(
            "unsupported", F.coalesce("unsupported", F.array().cast("array<string>"))
        )
    )


def grounding(answers: DataFrame, evidence: DataFrame, mode: str = "exact") -> DataFrame:
    """Check answers(question_id, answer) against evidence(question_id, evidence).

    Evidence may hold any number of texts per question. Of each text only the tokens that
    the answer wants go on; the answers are computed once and stored.
    """
    by = ["question_id"]
    stored = materialize(answers, "answers")
    wanted = stored.select(*by, F.explode(number_tokens(F.col("answer"), mode)).alias("token"))
    lists = wanted.groupBy(*by).agg(F.collect_set("token").alias("wanted"))
    texts = evidence.select(*by, number_tokens(F.col("evidence"), mode).alias("tokens"))
    shared = F.explode(F.array_intersect("tokens", "wanted")).alias("token")
    given = texts.join(lists, by).select(*by, shared).distinct()
    missing = wanted.join(given, [*by, "token"], "left_anti")
    return _verdict(stored, missing, by)


def token_cells(txns: DataFrame, mode: str, wanted: DataFrame) -> DataFrame:
    """Wanted tokens of all transactions per (category, merchant), with the newest date.

    Every window ends on the newest date of the table, so a token occurs in a window
    exactly if its newest date is not before the window's first day. ``wanted`` (token) is
    a stored table, so Spark knows its size and how to join it.
    """
    tokens = txns.select(
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("merchant", F.lit("")).alias("merchant"),
        "date",
        F.explode(number_tokens(evidence_text(txns), mode)).alias("token"),
    )
    present = tokens.join(wanted, "token", "left_semi")
    return present.groupBy("token", *CELL).agg(F.max("date").alias("newest"))


def ground_sets(
    sets: DataFrame,
    kept: DataFrame,
    txns: DataFrame,
    starts: Starts,
    mode: str = "exact",
) -> DataFrame:
    """Check sets(hits, window, matched, answer) against the rows that answer them.

    Same result as ``grounding`` over the rows of ``matching_transactions``, without
    producing those rows: a token is supported if it occurs in one of the cells the set
    keeps or, for a set that falls back to its window, in any cell.
    """
    in_time = (F.col("window") == ALL_TIME) | (
        F.col("newest") >= start_of(F.col("window"), starts)
    )
    wanted = sets.select(
        *SET, "matched", F.explode(number_tokens(F.col("answer"), mode)).alias("token")
    )
    listed = materialize(wanted.select("token").distinct(), "wanted-tokens")
    tokens = materialize(token_cells(txns, mode, listed), "tokens")
    anywhere = tokens.groupBy("token").agg(F.max("newest").alias("newest"))
    # Most sums occur in no transaction at all; only the rest are looked for in cells.
    present = materialize(wanted.join(anywhere, "token"), "present")
    of_matched = present.filter("matched").select(*SET, "token")
    from_cells = balanced_join(kept.select(*SET, *CELL), of_matched, SET)
    from_hits = from_cells.join(tokens, ["token", *CELL])
    from_window = present.filter("not matched")

    key = [*SET, "token"]
    supported = (
        from_hits.filter(in_time)
        .select(*key)
        .unionByName(from_window.filter(in_time).select(*key))
        .distinct()
    )
    missing = wanted.select(*key).join(supported, key, "left_anti")
    return _verdict(sets, missing, SET)
