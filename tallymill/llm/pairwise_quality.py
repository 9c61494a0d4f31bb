"""Document quality by Bradley-Terry ranking of pairs.

A document is a vector of features of its text. In a preference pair one document is good
and the other is not; the chance that the good one wins is the logistic function of the
difference of their scores, and a score is linear in the features. So the weights minimise
logistic loss on feature differences, which Newton's method finds.

Every usable label counts. The labelled documents are dealt by a hash of the key into blocks
of about ``MOST_LABELS``, and each meets some documents of the other kind in its block: pairs
grow with the labels, not with their square. Where one kind is rare, its documents are in
several blocks, so that each block has about ``RARE_IN_BLOCK`` of them. Tasks sum gradient and
curvature of their blocks, and one small row per task reaches the driver in each step.

Bradley-Terry scores have no zero. The threshold is the exact quantile of the scores of all
labels at the share of bad documents. The published score is logistic around it, so that
documents above the quantile have ``THRESHOLD`` or more.

Defined cases: null and empty texts have features too (all counts zero) and a score. Labels
that are null or belong to no document are not used; a document with several labels is used
with each. Without labels of both kinds all scores are equal to ``THRESHOLD``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import map_slices, utf8
from tallymill.session import discard, materialize

#: Labels that are paired with each other, and scores that are ranked in one place.
MOST_LABELS = 20_000
#: Documents of the rarer kind in a block, of those there are.
RARE_IN_BLOCK = 200
PAIRS_PER_BAD = 20
MOST_PAIRS = 200_000
#: Pairs whose differences are held at once.
PAIRS_AT_ONCE = 10_000
PENALTY = 1.0
THRESHOLD = 0.3

SYMBOLS = b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b'"', b":", b";")

FEATURES = (
    "log_words",
    "letters",
    "upper",
    "digits",
    "spaces",
    "symbols",
    "marks",
    "exclamations",
    "other_bytes",
    "word_length",
    "word_spread",
    "distinct_words",
    "top_word",
    "entropy",
    "symbol_words",
    "upper_words",
    "short_words",
    "long_words",
    "line_length",
    "ended_lines",
    "repeated_lines",
    "repeated_pairs",
    "is_empty",
)


def features(text: bytes | None) -> np.ndarray:
    """Shares and means of a text, each about 0 to 10."""
    text = text or b""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper = counts[97:123].sum(), counts[65:91].sum()
    high = counts[128:].sum()
    digits = counts[48:58].sum()
    spaces = counts[32] + counts[9:14].sum()
    symbols = counts[list(SYMBOLS)].sum()
    rest = size - lower - upper - high - digits - spaces - symbols
    shares = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    n_lines = max(len(lines), 1)
    symbol_words = sum(c for word, c in seen.items() if word[-1] in SYMBOLS)
    upper_words = sum(c for word, c in seen.items() if len(word) > 1 and word.isupper())
    return np.array(
        [
            np.log1p(len(words)),
            (lower + upper + high) / size,
            10 * upper / size,
            10 * digits / size,
            spaces / size,
            10 * symbols / size,
            10 * max(rest, 0) / size,
            10 * counts[33] / size,
            high / size,
            min(lengths.mean(), 50) / 5,
            min(lengths.std(), 50) / 5,
            len(seen) / n,
            max(seen.values(), default=0) / n,
            -(shares * np.log2(shares)).sum() if text else 0.0,
            symbol_words / n,
            upper_words / n,
            (lengths <= 2).mean(),
            (lengths > 15).mean(),
            np.log1p(size / n_lines),
            sum(line.endswith(ENDS) for line in lines) / n_lines,
            1 - len(set(lines)) / n_lines,
            1 - len(set(zip(words, words[1:]))) / max(len(words) - 1, 1) if len(words) > 1 else 0,
            float(not words),
        ]
    )


@dataclass
class Ranker:
    """Scores linear in features and their squares, learned from preference pairs."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    limit: float = 0.0

    def expanded(self, vectors: np.ndarray) -> np.ndarray:
        scaled = np.clip((vectors - self.mean) / self.spread, -8, 8)
        return np.concatenate((scaled, scaled**2 / 4), axis=1)

    def plain_scores(self, vectors: np.ndarray) -> np.ndarray:
        return self.expanded(vectors) @ self.weights

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """0 to 1, ``THRESHOLD`` at the quantile."""
        over = self.plain_scores(vectors) - self.limit
        offset = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(over + offset, -500, 500)))


#: Sums over pairs of differences, at some weights: how many, and gradient and curvature of the loss.
Sums = tuple[int, np.ndarray, np.ndarray]


def pair_sums(differences: np.ndarray, weights: np.ndarray) -> Sums:
    lose = 1 / (1 + np.exp(np.clip(differences @ weights, -500, 500)))
    curve = (differences * (lose * (1 - lose))[:, None]).T @ differences
    return len(differences), -(differences.T @ lose), curve


def descend(sums_at: Callable[[np.ndarray], Sums], size: int, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean loss of the pairs behind ``sums_at`` plus a ridge penalty."""
    weights = np.zeros(size)
    ridge = penalty * np.eye(size) / 100
    for _ in range(steps):
        pairs, slope, curve = sums_at(weights)
        gradient = ridge @ weights + slope / pairs
        step = np.linalg.solve(curve / pairs + ridge, gradient)
        weights = weights - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def newton(differences: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of ``differences`` plus a ridge penalty."""
    return descend(lambda weights: pair_sums(differences, weights), differences.shape[1], penalty, steps)


def _drawn(chance: np.random.Generator, rows: int, n: int) -> np.ndarray:
    """``n`` numbers of rows, each row as often as any other."""
    return np.concatenate([chance.permutation(rows) for _ in range(-(-n // rows))])[:n]


def pairs_of(goods: int, bads: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of good and bad documents that meet; every document of both kinds does."""
    most = max(goods, bads)
    n = max(min(MOST_PAIRS, PAIRS_PER_BAD * most), most) if goods and bads else 0
    chance = np.random.default_rng(seed)
    return (_drawn(chance, goods, n), _drawn(chance, bads, n)) if n else (np.zeros(0, int),) * 2


def vectors_of(docs: DataFrame, text: str, carry: Sequence[str]) -> DataFrame:
    """(carried columns, vector) of documents."""
    source = docs.select(*carry, F.col(text).alias("text"))
    schema = StructType([*[source.schema[name] for name in carry]])
    schema = StructType([*schema.fields, *StructType.fromDDL("vector array<double>").fields])

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = pa.array([features(x) for x in utf8(batch.column("text"))], pa.list_(pa.float64()))
            return pa.record_batch(
                [*[batch.column(name) for name in carry], vectors], schema.names
            )

        return work

    return map_slices(source, schema, factory)


def _in_blocks(known: DataFrame, counts: dict[int, int], most: int) -> DataFrame:
    """known(key, label, vector) with ``block``; a rare label is in several blocks."""
    blocks = -(-sum(counts.values()) // most)
    home = F.pmod(F.xxhash64("key", "label"), F.lit(blocks))
    copies = F.lit(1)
    for label, rows in counts.items():
        needed = min(blocks, -(-RARE_IN_BLOCK * blocks // rows))
        copies = F.when(F.col("label") == label, F.lit(needed)).otherwise(copies)
    places = F.transform(F.sequence(F.lit(0), copies - 1), lambda at: F.pmod(home + at, F.lit(blocks)))
    dealt = known.select(F.explode(places).alias("block"), "key", "label", "vector")
    return dealt.repartition(blocks, "block")


def _packed(known: DataFrame) -> DataFrame:
    """(block, good, bad): the vectors of each block, in the order of their values."""

    def pack(group: pa.Table) -> pa.Table:
        vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        labels = group.column("label").to_numpy()
        vectors, labels = (x[np.lexsort(vectors.T)] for x in (vectors, labels))
        kinds = [pa.array([vectors[labels == label].tobytes()], pa.binary()) for label in (1, 0)]
        return pa.table([group.column("block").slice(0, 1).combine_chunks(), *kinds], ["block", "good", "bad"])

    return known.groupBy("block").applyInArrow(pack, "block long, good binary, bad binary")


def _block_sums(blocks: DataFrame, ranker: Ranker, weights: np.ndarray) -> Sums:
    """Sums over the pairs of all blocks; each task adds up its own."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, slope, curve, first = 0, np.zeros(size), np.zeros((size, size)), None
        for batch in batches:
            for block, *packed in zip(*[batch.column(name).to_pylist() for name in ("block", "good", "bad")]):
                good, bad = (
                    ranker.expanded(np.frombuffer(kind).reshape(-1, len(FEATURES))) for kind in packed
                )
                first = block if first is None else min(first, block)
                of_good, of_bad = pairs_of(len(good), len(bad))
                for at in range(0, len(of_good), PAIRS_AT_ONCE):
                    part = slice(at, at + PAIRS_AT_ONCE)
                    found = pair_sums(good[of_good[part]] - bad[of_bad[part]], weights)
                    pairs, slope, curve = pairs + found[0], slope + found[1], curve + found[2]
        if first is not None:
            numbers = np.concatenate(([pairs], slope, curve.ravel()))
            yield pa.record_batch([pa.array([first], pa.int64()), pa.array([numbers.tobytes()])], ["first", "sums"])

    rows = blocks.mapInArrow(run, "first long, sums binary").collect()
    total = sum(np.frombuffer(row["sums"]) for row in sorted(rows))
    return int(total[0]), total[1 : size + 1], total[size + 1 :].reshape(size, size)


def _plain_scores(known: DataFrame, ranker: Ranker) -> DataFrame:
    """(score) of known(vector)."""

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = batch.column("vector").flatten().to_numpy().reshape(-1, len(FEATURES))
            return pa.record_batch([pa.array(ranker.plain_scores(vectors))], ["score"])

        return work

    return map_slices(known.select("vector"), "score double", factory)


def _value_at(scores: DataFrame, rank: int, most: int) -> float:
    """The score of that rank, from 0: the range it lies in is cut until few scores are left."""
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    inside = scores
    while n > most and low < high:
        width = (high - low) / most
        place = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(width)), F.lit(most - 1))
        bins = inside.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")
        )
        for found in bins.orderBy("bin").toLocalIterator():
            if rank < found.n:
                break
            rank -= found.n
        if (found.low, found.high) == (low, high):
            break  # the range is too narrow to be cut
        low, high, n = found.low, found.high, found.n
        inside = scores.filter(F.col("score").between(low, high))
    if low == high:
        return low
    counted = inside.groupBy("score").agg(F.count("*").alias("n")).orderBy("score")
    for found in counted.toLocalIterator():
        if rank < found.n:
            return found["score"]
        rank -= found.n
    return high


def quantile(scores: DataFrame, share: float, total: int, most: int = MOST_LABELS) -> float:
    """The exact quantile of scores(score), between the two scores next to it."""
    place = share * (total - 1)
    below = int(place)
    value = _value_at(scores, below, most)
    if place == below:
        return value
    up_to, above = scores.agg(
        F.count_if(F.col("score") <= value), F.min(F.when(F.col("score") > value, F.col("score")))
    ).first()
    after = value if up_to > below + 1 or above is None else above
    return float(value + (after - value) * (place - below))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    key: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    most: int = MOST_LABELS,
) -> Ranker:
    """Fit on all usable labels, paired in blocks of about ``most``."""
    known = labels.filter(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label")
    )
    named = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Vectors are far smaller than texts, which need not be moved to meet the labels.
    vectors = materialize(vectors_of(named, "text", ["key"]).join(known, "key"), "label-vectors")
    counts = {row.label: row.n for row in vectors.groupBy("label").agg(F.count("*").alias("n")).collect()}
    plain = Ranker(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES)))
    if len(counts) < 2:
        discard(vectors)
        return plain
    features_at = [F.get("vector", F.lit(at)) for at in range(len(FEATURES))]
    told = vectors.agg(*map(F.avg, features_at), *map(F.stddev_pop, features_at)).first()
    mean, spread = np.array(told).reshape(2, -1)
    ranker = Ranker(mean, np.where(spread > 1e-9, spread, 1.0), plain.weights)
    blocks = materialize(_packed(_in_blocks(vectors, counts, most)), "label-blocks")
    ranker.weights = descend(lambda weights: _block_sums(blocks, ranker, weights), 2 * len(FEATURES))
    scores = materialize(_plain_scores(vectors, ranker), "label-scores")
    total = sum(counts.values())
    ranker.limit = quantile(scores, counts[0] / total, total)
    for table in (vectors, blocks, scores):
        discard(table)
    return ranker


def scored(
    docs: DataFrame, ranker: Ranker, text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """(row, score, predicted) for each document."""
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns])
    source = docs.select(carried.alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    schema = StructType([source.schema["row"]]).add("score", "double").add("predicted", "integer")

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = [features(value) for value in utf8(batch.column("text"))]
            scores = shared.value.scores(np.array(vectors).reshape(-1, len(FEATURES)))
            predicted = (scores >= THRESHOLD).astype(np.int32)
            return pa.record_batch(
                [batch.column("row"), pa.array(scores), pa.array(predicted)], schema.names
            )

        return work

    return map_slices(source, schema, factory)
