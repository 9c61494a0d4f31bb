"""Jaccard similarity join on word shingles, with candidates pruned by Bayesian inference.

1. Each document becomes the set of its shingles (64-bit hashes of five words). Documents
   with equal sets are one class from here on; a class weighs as many documents as it has.
2. A class has ``HASHES`` MinHash values in ``BANDS`` bands. Classes that agree in a whole
   band are a bucket. Two classes of similarity 0.8 share no band with probability 3e-5.
3. Within a bucket, MinHash values are compared some at a time. A pair goes as soon as the
   posterior probability that its similarity reaches the threshold, given the agreements
   so far and a flat prior, is below ``TOLERANCE``. What stays joins classes to clusters.
4. Within a cluster the sets themselves are compared, for pairs that stay after pruning:
   links are exact. Each class gets its number of links and linked documents.

Buckets and clusters are dealt into blocks of about ``BLOCK`` classes, and a task takes a
pair of blocks. It hands on a spanning forest and counts, never all pairs of a group.

Defined cases: a text of one to four words is one shingle of all its words; null, empty and
blank texts have none and are linked to nothing, not to each other. Equal rows are copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tallymill.llm.common import map_slices, row_key, utf8
from tallymill.llm.graph import components
from tallymill.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 26
ROWS = 5
HASHES = BANDS * ROWS
#: After so many MinHash values a pair may be dropped.
CHECKS = (32, 64, 96, HASHES)
TOLERANCE = 1e-6
BLOCK = 512
KNOWN_WORDS = 200_000
COLUMNS = 8_192
#: MinHash values are compared by their last byte, which two unequal ones share so often.
CHANCE = 1 / 256


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a text."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    mixed = np.full(n, min(size, len(words)), np.uint64)
    for at in range(min(size, len(words))):
        mixed = (mixed + values[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


_SEED = np.random.default_rng(20_011)
FACTORS = (_SEED.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1))[:, None]
SHIFTS = _SEED.integers(0, 2**32, HASHES, np.uint32)[:, None]


def minhashes(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, HASHES 32-bit numbers."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1_024):
        mixed = short[None, at : at + 1_024] * FACTORS
        mixed += SHIFTS
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each check the fewest agreements with which a pair is kept.

    The likelihood of m agreements among n is binomial in the chance that two values agree,
    which is the similarity or else the chance of equal last bytes.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    agree = grid + (1 - grid) * CHANCE
    needed = {}
    for n in CHECKS:
        for m in range(n + 1):
            weight = m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(weight - weight.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                needed[n] = m
                break
    return needed


def survivors(left: np.ndarray, right: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Which rows of two equally long lists of sketches are still candidates after all checks."""
    alive, matches, start = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n in CHECKS:
        matches = matches + (left[alive, start:n] == right[alive, start:n]).sum(axis=1)
        keep = matches >= needed[n]
        alive, matches, start = alive[keep], matches[keep], n
    return alive


def whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of rows sorted by ``key`` that end where a group ends."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        same = np.ones(now.num_rows, bool)
        for name in key:
            values = now[name].to_numpy()
            same &= values == values[-1]
        others = np.flatnonzero(~same)
        start = int(others[-1]) + 1 if len(others) else 0
        if start:
            yield now.slice(0, start)
        rest = now.slice(start).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


class Trees:
    """Labels of trees over the rows 0..n-1, and the pairs that joined two of them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.pairs: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray, start: int = 0, end: int | None = None) -> None:
        """Join row i with other rows; all rows of their trees are in [start, end)."""
        labels, first = np.unique(self.label[others], return_index=True)
        part = self.label[start:end]
        for old, at in zip(labels.tolist(), first.tolist()):
            if old != self.label[i]:
                self.pairs.append((i, int(others[at])))
                part[part == old] = self.label[i]


def group_bounds(rows: pa.Table, key: Sequence[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows + 1, bool)
    new[0] = new[-1] = True
    for name in key:
        values = rows[name].to_numpy()
        new[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def sketches_of(rows: pa.Table) -> np.ndarray:
    joined = b"".join(rows["sketch"].to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(rows.num_rows, HASHES)


PAIR_KEY = ("bucket", "block_a", "block_b")


def candidate_edges(needed: dict[int, int]) -> Callable:
    """Pairs of each pair of blocks that outlive pruning, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, PAIR_KEY):
            bounds = group_bounds(rows, PAIR_KEY)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            own = rows["own"].to_numpy()
            across = rows["block_a"].to_numpy() != rows["block_b"].to_numpy()
            sketches, names = sketches_of(rows), rows["cls"].to_pylist()
            trees = Trees(len(group))
            start = np.arange(len(group))
            for step in range(1, int(np.diff(bounds).max())):
                start = start[start < len(group) - step]
                start = start[group[start] == group[start + step]]
                # What is in one tree already needs no further comparison.
                open_pair = trees.label[start] != trees.label[start + step]
                left = start[open_pair & (~across[start] | (own[start] != own[start + step]))]
                for i in left[survivors(sketches[left], sketches[left + step], needed)].tolist():
                    at = group[i]
                    trees.join(i, np.array([i + step]), bounds[at], bounds[at + 1])
            yield pa.record_batch(
                [
                    pa.array([names[pair[at]] for pair in trees.pairs], pa.binary())
                    for at in (0, 1)
                ],
                ["u", "v"],
            )

    return run


def in_block_pairs(members: DataFrame, key: str, size: str) -> DataFrame:
    """members, repeated for each pair of blocks of their group that they belong to.

    Adds own (block), block_a, block_b; a group of up to ``BLOCK`` members is one block.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("block_a", F.least("own", "_other"))
        .withColumn("block_b", F.greatest("own", "_other"))
        .drop("_other", size)
        .repartition(key, "block_a", "block_b")
        .sortWithinPartitions(key, "block_a", "block_b")
    )


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, key_a, key_b, n_shingles, cls, sketch, buckets) for each document.

    ``cls`` names the set of shingles; it is null where there are none.
    """
    source = docs.select(F.col(key).alias("key"), *row_key(docs), F.col(text).alias("text"))
    schema = StructType([source.schema[name] for name in ("key", "key_a", "key_b")])
    schema = schema.add("n_shingles", "long").add("cls", "binary").add("sketch", "binary")
    schema = schema.add("buckets", ArrayType(LongType()))

    def factory():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, classes, sketches, buckets = [], [], [], []
            for value in utf8(batch.column("text")):
                found = shingles(value, hashes)
                sizes.append(len(found))
                if not len(found):
                    classes.append(None)
                    sketches.append(None)
                    buckets.append(None)
                    continue
                least = minhashes(found)
                classes.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(least.astype(np.uint8).tobytes())
                bands = np.ascontiguousarray(least.reshape(BANDS, ROWS))
                buckets.append(
                    [
                        xxhash.xxh3_64_intdigest(band.tobytes(), at) - (1 << 63)
                        for at, band in enumerate(bands)
                    ]
                )
            return pa.record_batch(
                [
                    *[batch.column(name) for name in ("key", "key_a", "key_b")],
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.array(sketches, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                schema.names,
            )

        return work

    return map_slices(source, schema, factory)


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """(cls, cluster) for classes(cls, sketch, buckets) that have a candidate partner."""
    members = classes.select("cls", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = members.join(sizes, "bucket").join(classes.select("cls", "sketch"), "cls")
    pairs = in_block_pairs(shared, "bucket", "size")
    edges = pairs.mapInArrow(candidate_edges(least_matches()), "u binary, v binary")
    return components(edges).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, exact."""
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    total = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    for start in range(0, len(values), COLUMNS):
        a, b = np.searchsorted(codes, (start, start + COLUMNS))
        marks = np.zeros((len(left) + len(right), min(COLUMNS, len(values) - start)), np.float32)
        marks[rows[a:b], codes[a:b] - start] = 1
        total += marks[: len(left)] @ marks[len(left) :].T
    return total.astype(np.int64)


VERIFY_KEY = ("group", "block_a", "block_b")
VERIFIED = "cls binary, n_texts long, n_docs long, partner binary"


def verified_links(needed: dict[int, int], threshold: float = THRESHOLD) -> Callable:
    """Exact links within each pair of blocks of a cluster.

    Rows (cls, n_texts, n_docs, null) count a class's links and the documents behind them;
    rows (cls, 0, 0, partner) are a spanning forest of the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in whole_groups(batches, VERIFY_KEY):
            out: list[tuple] = []
            bounds = group_bounds(rows, VERIFY_KEY)
            for a, b in zip(bounds[:-1], bounds[1:]):
                out += block_links(rows.slice(a, b - a), hashes, needed, threshold)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch(columns, ["cls", "n_texts", "n_docs", "partner"])

    return run


def block_links(
    rows: pa.Table, hashes: WordHashes, needed: dict[int, int], threshold: float
) -> list[tuple]:
    own = rows["own"].to_numpy()
    first, second = rows["block_a"][0].as_py(), rows["block_b"][0].as_py()
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
    if not len(left) or not len(right) or rows.num_rows < 2:
        return []
    sketches, names = sketches_of(rows), rows["cls"].to_pylist()
    weights = rows["weight"].to_numpy()
    alive = np.zeros((len(left), len(right)), bool)
    for at, i in enumerate(left):
        later = np.flatnonzero(right > i) if first == second else np.arange(len(right))
        them = right[later]
        mine = np.broadcast_to(sketches[i], (len(them), HASHES))
        alive[at, later[survivors(mine, sketches[them], needed)]] = True
    some_left, some_right = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    if not len(some_left):
        return []
    texts = utf8(rows["text"].combine_chunks())
    sets = {i: shingles(texts[i], hashes) for i in {*left[some_left], *right[some_right]}}
    left_sets = [sets[i] for i in left[some_left]]
    right_sets = [sets[i] for i in right[some_right]]
    both = overlaps(left_sets, right_sets)
    union = (
        np.array([len(x) for x in left_sets])[:, None]
        + np.array([len(x) for x in right_sets])[None, :]
        - both
    )
    # 1e-12 keeps a similarity of exactly the threshold.
    linked = alive[np.ix_(some_left, some_right)] & (both >= union * (threshold - 1e-12))
    lefts, rights = left[some_left], right[some_right]
    n_texts, n_docs = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    n_texts[lefts] += linked.sum(axis=1)
    n_texts[rights] += linked.sum(axis=0)
    n_docs[lefts] += linked @ weights[rights]
    n_docs[rights] += weights[lefts] @ linked
    trees = Trees(len(names))
    for at in np.flatnonzero(linked.any(axis=1)):
        trees.join(int(lefts[at]), rights[linked[at]])
    out = [(names[i], int(n_texts[i]), int(n_docs[i]), None) for i in np.flatnonzero(n_texts)]
    return out + [(names[a], 0, 0, names[b]) for a, b in trees.pairs]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: key, key_a, key_b (its row), n_shingles, class_id, n_texts, n_links.

    ``class_id`` is the least key of the documents that links and equal sets connect,
    ``n_texts`` the number of other shingle sets of similarity 0.8 or more, ``n_links`` the
    number of other documents of similarity 0.8 or more, copies included.
    """
    rows = materialize(sketched(docs, key, text), "sketches")
    classes = materialize(
        rows.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(
            F.count("*").alias("weight"),
            F.first("sketch").alias("sketch"),
            F.first("buckets").alias("buckets"),
            F.min(F.struct("key_a", "key_b")).alias("sample"),
        ),
        "classes",
    )
    clusters = materialize(candidate_clusters(classes), "clusters")
    found = materialize(_verify(docs, text, classes, clusters), "links")
    counts = (
        found.filter("partner IS NULL")
        .groupBy("cls")
        .agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    )
    edges = found.filter("partner IS NOT NULL").select(
        F.col("cls").alias("u"), F.col("partner").alias("v")
    )
    linked = components(edges).withColumnRenamed("node", "cls")
    known = (
        classes.select("cls", "weight")
        .join(counts, "cls", "left")
        .join(linked, "cls", "left")
        .select(
            "cls",
            F.coalesce("component", "cls").alias("component"),
            F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
            (F.coalesce("n_docs", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    placed = materialize(rows.drop("sketch", "buckets").join(known, "cls", "left"), "placed")
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(
        F.min("key").alias("least")
    )
    return placed.join(least, "component", "left").select(
        "key",
        "key_a",
        "key_b",
        "n_shingles",
        F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "component",
    )


def _verify(docs: DataFrame, text: str, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    wanted = (
        clusters.join(sizes, "cluster")
        .join(classes.select("cls", "weight", "sketch", "sample"), "cls")
        .select(
            "cls",
            F.xxhash64("cluster").alias("group"),
            "size",
            "weight",
            "sketch",
            F.col("sample.key_a").alias("key_a"),
            F.col("sample.key_b").alias("key_b"),
        )
    )
    texts = docs.select(*row_key(docs), F.col(text).alias("text"))
    # Equal rows have one key: any of their copies serves.
    with_text = (
        wanted.join(texts, ["key_a", "key_b"]).drop("key_a", "key_b").dropDuplicates(["cls"])
    )
    pairs = in_block_pairs(with_text, "group", "size")
    return pairs.mapInArrow(verified_links(least_matches()), VERIFIED)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the first row by key.

    Documents without shingles all stay. Of equal rows one stays.
    """
    found = near_duplicates(docs, key, text)
    first = F.min(F.struct("key", "key_a", "key_b")).alias("first")
    grouped = found.filter("component IS NOT NULL").groupBy("component").agg(first)
    kept = grouped.select(F.col("first.key_a").alias("key_a"), F.col("first.key_b").alias("key_b"))
    copies = found.groupBy("key_a", "key_b").agg(F.count("*").alias("copies"))
    blank = found.filter("component IS NULL").select("key_a", "key_b").distinct()
    wanted = materialize(
        kept.join(copies, ["key_a", "key_b"])
        .unionByName(blank.withColumn("copies", F.lit(1).cast("long"))),
        "kept",
    )
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), *row_key(docs))
    chosen = rows.join(wanted, ["key_a", "key_b"])
    single = chosen.filter("copies = 1").select("row.*")
    return single.unionByName(chosen.filter("copies > 1").select("row").distinct().select("row.*"))
