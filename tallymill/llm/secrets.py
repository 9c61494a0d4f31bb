"""Secrets in texts: fixed patterns, and random strings found by character Markov models.

Three patterns find assignments, access keys and hexadecimal strings. A fourth kind,
``markov``, is any run of eight or more key characters that reads like a random string: two
Markov models of character pairs, one of secrets and one of ordinary identifiers, give a log
likelihood ratio, and nothing else decides. From 20 characters on the mean per pair must be
high enough; shorter runs hold less evidence, and their sum must make up for how much more
frequent identifiers are. The pieces between ``/ - _ =`` of a run are judged like whole runs,
and reported where the whole run is not.

The models are trained on labelled strings. A table of them may be given. Else all documents give
them: what the patterns find is labelled secret, the identifiers outside of it ordinary. Such
labels are wrong where a secret fits no pattern. So what the models then call random is left out
of the ordinary strings and they are counted again, up to ``ROUNDS`` times or until the same
strings are left.

All work is column expressions. The start of a match is the total length of what stands
before it: texts are split by the pattern, and one fold over the parts and matches adds the
lengths up. The fold keeps matches that pass only, so its work grows with the text, and with
the square of the secrets of a single text.

Defined cases: a null text is empty and has no spans. Equal rows are judged alike. Positions
count code points from 0, ends are exclusive. Without secrets the model of secrets is
uniform; without an identifier outside of them no run is reported.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import discard, materialize

KINDS = ("assign", "access", "hex", "markov")

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
#: What may join a key to other words, and the pieces between.
JOINT = r"[/_=-]"
PIECE = r"[A-Za-z0-9+]{8,}"
#: From this length on the mean ratio decides.
LONG = 20
#: Mean per pair of characters. Above 0 a random string is the likelier reading.
LEAST_RATIO = 0.0
#: Times that ordinary strings are cleared of what looks random.
ROUNDS = 3

SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def spans(
    text: Column,
    pattern: str,
    kind: int,
    group: int = 0,
    least: int = 0,
    passes: Callable[[Column], Column] | None = None,
    cut: str | None = None,
) -> Column:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters, leftmost first.

    Only those that pass; with ``cut``, also matches of that pattern inside of a match.
    """
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        parts, found, lambda part, match: F.struct(part.alias("part"), match.alias("match"))
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(done: Column, piece: Column) -> Column:
        begin = done["at"] + F.length(piece["part"])
        end = begin + F.coalesce(F.length(piece["match"]), F.lit(0))
        value = F.regexp_extract(piece["match"], pattern, group) if group else piece["match"]
        span = F.struct(
            begin.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            value.alias("value"),
        )
        there = piece["match"].isNotNull() & (F.length(value) >= least)
        keep = there & passes(value) if passes else there
        more = F.when(keep, F.concat(done["spans"], F.array(span).cast(SPAN)))
        all_spans = more.otherwise(done["spans"])
        if cut:
            inner = F.transform(
                spans(value, cut, kind, passes=passes),
                lambda part: F.struct(
                    (part["start"] + begin).alias("start"),
                    part["kind"].alias("kind"),
                    (part["end"] + begin).alias("end"),
                    part["value"].alias("value"),
                ),
            )
            parted = there & value.rlike(JOINT)
            all_spans = F.when(parted, F.concat(all_spans, inner)).otherwise(all_spans)
        return F.struct(end.cast("long").alias("at"), all_spans.alias("spans"))

    return F.aggregate(pieces, start, step, lambda done: done["spans"])


def base_spans(text: Column) -> Column:
    return F.concat(
        spans(text, ASSIGN, 0, group=2, least=LEAST_VALUE),
        spans(text, ACCESS, 1),
        spans(text, HEX, 2),
    )


def pairs(value: Column) -> Column:
    """Neighbouring characters of a string, as strings of two."""
    letters = F.split(value, "")
    following = F.slice(letters, F.lit(2), F.greatest(F.length(value) - 1, F.lit(0)))
    joined = F.zip_with(letters, following, lambda a, b: F.concat(a, b))
    return F.filter(joined, lambda pair: pair.isNotNull())


def _pair_counts(values: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Counts of character pairs of values(secret, value, n), of secrets and of the others.

    At most twice as many rows as the alphabet has pairs.
    """
    exploded = values.select("secret", "n", F.explode(pairs(F.col("value"))).alias("pair"))
    within = exploded.filter(F.col("pair").rlike(rf"^[{ALPHABET[:-1]}\-]{{2}}$"))
    counted = within.groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect()
    return tuple({x["pair"]: x["n"] for x in counted if x["secret"] == it} for it in (True, False))


def _log_transitions(counts: dict[str, int]) -> list[list[float]]:
    """Log chances of the next character, with one added to each count."""
    rows = []
    for first in ALPHABET:
        own = [counts.get(first + second, 0) + 1 for second in ALPHABET]
        rows.append([math.log(n / sum(own)) for n in own])
    return rows


def outside(text: Column, found: Column) -> Column:
    """What stands between the found spans, as an array of texts."""
    ordered = F.array_sort(found)
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")
    )

    def step(done: Column, span: Column) -> Column:
        # Spans of different patterns may overlap.
        size = F.greatest(span["start"] - done["at"], F.lit(0)).cast("int")
        part = F.substring(text, (done["at"] + 1).cast("int"), size)
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.concat(done["parts"], F.array(part)).alias("parts"),
        )

    def rest(done: Column) -> Column:
        last = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
        return F.concat(done["parts"], F.array(last))

    # Most texts have no span; they are not cut.
    return F.when(F.size(found) == 0, F.array(text)).otherwise(
        F.aggregate(ordered, start, step, rest)
    )


class Models(NamedTuple):
    """Log likelihood ratios of all pairs, secrets against identifiers, and the log of how
    many times more frequent the pairs of identifiers are."""

    ratios: list[float]
    odds: float


def labelled_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(value, secret): the values of the patterns' spans in all documents, and the identifiers
    that stand outside these spans."""
    based = docs.filter(F.col(text).isNotNull()).select(
        F.col(text).alias("text"), base_spans(F.col(text)).alias("found")
    )
    identifiers = F.flatten(
        F.transform(
            outside(F.col("text"), F.col("found")),
            lambda part: F.regexp_extract_all(part, F.lit(IDENTIFIER), F.lit(0)),
        )
    )

    def marked(values: Column, secret: bool) -> Column:
        return F.transform(
            values, lambda value: F.struct(F.lit(secret).alias("secret"), value.alias("value"))
        )

    labelled = F.concat(marked(F.col("found.value"), True), marked(identifiers, False))
    return based.select(F.explode(labelled).alias("one")).select("one.value", "one.secret")


def _models(values: DataFrame) -> Models | None:
    counts = _pair_counts(values)
    if not counts[1]:
        return None
    random, ordinary = map(_log_transitions, counts)
    ratios = [a - b for one, other in zip(random, ordinary) for a, b in zip(one, other)]
    n_secret, n_ordinary = (sum(own.values()) for own in counts)
    return Models(ratios, max(0.0, math.log(n_ordinary / max(n_secret, 1))))


def looks_random(value: Column, models: Models, least_ratio: float = LEAST_RATIO) -> Column:
    """Whether a string of key characters is likelier random than ordinary."""
    n_pairs = F.length(value) - 1
    least = F.when(n_pairs + 1 >= LONG, F.lit(least_ratio)).otherwise(models.odds / n_pairs)
    return mean_ratio(value, models.ratios) >= least


def train(labelled: DataFrame, rounds: int = ROUNDS, least_ratio: float = LEAST_RATIO) -> Models | None:
    """The models of labelled strings(value, secret); None without an ordinary one.

    With ``rounds``, ordinary strings that look random to the models are left out, and the models
    counted again.
    """
    strings = labelled.filter("value IS NOT NULL AND secret IS NOT NULL").select("secret", "value")
    counted = strings.groupBy("secret", "value").agg(F.count("*").alias("n"))
    stored = materialize(counted, "strings")
    models, left_out = _models(stored), 0
    for _ in range(rounds):
        if models is None:
            break
        apart = ~F.col("secret") & looks_random(F.col("value"), models, least_ratio)
        n = stored.filter(apart).count()
        if n == left_out:
            break
        cleared = _models(stored.filter(~apart))
        models, left_out = cleared or models, n
    discard(stored)
    return models


def mean_ratio(value: Column, ratios: Sequence[float]) -> Column:
    """Mean log likelihood ratio of the pairs of a string."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    codes = [str(ALPHABET.find(chr(point))) for point in range(128)]
    code_of = F.split(F.lit(",".join(codes)), ",").cast("array<int>")

    def ratio(pair: Column) -> Column:
        first = F.get(code_of, F.ascii(F.substring(pair, 1, 1)))
        second = F.get(code_of, F.ascii(F.substring(pair, 2, 1)))
        return F.get(table, first * len(ALPHABET) + second)

    total = F.aggregate(pairs(value), F.lit(0.0), lambda done, pair: done + ratio(pair))
    return total / F.greatest(F.length(value) - 1, F.lit(1))


def found_secrets(
    docs: DataFrame,
    text: str = "text",
    carry: Sequence[str] | None = None,
    least_ratio: float = LEAST_RATIO,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """(row, base, added) for each document: spans(start, kind, end, value) of the patterns,
    and of the Markov models where no pattern matched; both by start, then kind.

    ``labelled`` (value, secret) are strings to train on in place of those of the documents.
    """
    if labelled is None:
        models = train(labelled_strings(docs, text), least_ratio=least_ratio)
    else:
        models = train(labelled, 0)
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns]).alias("row")
    whole = F.coalesce(F.col("text"), F.lit(""))
    based = docs.select(carried, F.col(text).alias("text")).select(
        "row", "text", F.array_sort(base_spans(whole)).alias("base")
    )
    if models is None:
        return based.select("row", "base", F.array().cast(SPAN).alias("added"))

    def free(span: Column) -> Column:
        return ~F.exists(
            "base", lambda other: (other["start"] < span["end"]) & (span["start"] < other["end"])
        )

    def random(value: Column) -> Column:
        return looks_random(value, models, least_ratio)

    found = spans(whole, IDENTIFIER, 3, passes=random, cut=PIECE)
    judged = based.select("row", "base", F.filter(found, free).alias("free"))

    def outermost(span: Column) -> Column:
        return ~F.exists(
            "free",
            lambda other: (other["start"] <= span["start"])
            & (span["end"] <= other["end"])
            & (F.length(other["value"]) > F.length(span["value"])),
        )

    return judged.select("row", "base", F.filter("free", outermost).alias("added"))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(
        F.transform(
            found,
            lambda span: F.concat_ws(
                ":",
                F.get(names, span["kind"]),
                span["start"].cast("string"),
                span["end"].cast("string"),
            ),
        ),
        ",",
    )


def n_of(kind: str, found: str = "base") -> Column:
    at = KINDS.index(kind)
    return F.size(F.filter(found, lambda span: span["kind"] == at)).cast("long")
