"""Hard negatives of embeddings, found in a multiway hyperplane tree with distance ranges.

Vectors are made whole numbers, and a row's score is its inner product with the anchor. The
positives of an anchor are its best rows of the same label; the negatives of a positive are the
best rows of another label whose score is at least a share of the positive's and not above it.

Inner products become distances by one more coordinate: ``sqrt(M - |x|^2)``, with M the largest
squared length of all rows, puts all rows on one sphere, and an anchor with 0 there has
``d^2 = M + |q|^2 - 2 * score``. So a window of scores is an annulus around the anchor.

The tree is fitted on a sample of at most ``SAMPLE_ROWS`` rows, taken by hash. A node has up to
``WAYS`` split points far from each other, and a row goes to the child of its nearest one. Then
all rows are put in their leaves, and over all rows each split point stores the least and the
greatest distance to the rows of each sibling's subtree. An annulus rules out a sibling if,
for some split point, the distances that rows of the annulus can have to it do not meet that
range. Leaves are searched exactly. What remains of a window after the fifth best row of the
sample is out of reach of no row that counts.

Leaves are dealt into pieces and anchors into blocks of bounded size, so a leaf that holds a
third of all rows, such as copies of one vector, is the work of many tasks.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part. Where the id is divisible by ``MOVED``, the label first becomes ``(label + 1) % LABELS``.
Repeated rows are rows of their own, also beside an equal anchor; those of equal score and id
are interchangeable. A null id is no anchor and comes last among ties. Shorter vectors are as
if filled with zeros. Vectors whose squared length could pass 2^62 stop the job with an error.
Without anchors, positives or rows in the window, or with an empty table, there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import materialize

SCALE = 256
ANCHOR_EVERY = 100
MOVED, LABELS = 7, 10
N_POSITIVES, N_NEGATIVES = 5, 5
LEAST_SHARE = 80  # of 100

SAMPLE_ROWS = 8_192
WAYS = 16
#: A node of more sample rows is split.
LEAF_SAMPLE = 128
DEEPEST = 6
PIECE_ROWS = 16_384
BLOCK_ANCHORS = 2_048
#: Scores that a task looks at together.
TILE_SCORES = 4_000_000
#: Distances are compared with this much room for rounding, relative to the sphere.
ROOM = 1e-7

ROWS = "row long, id long, label int, norm long, v binary"
PLACED = "row long, id long, label int, v binary, leaf int"
FOUND = "anchor long, n int, row long, id long, score long"
LAST_ID = 2**63 - 1


@dataclass
class Space:
    """Length, number type and sphere of all vectors of a table."""

    width: int
    stored: str
    most: int

    def exact(self) -> str:
        """The fastest number type in which all inner products are exact."""
        return "f4" if self.most < 2**24 else "f8" if self.most < 2**53 else "i8"

    def read(self, vectors: pa.Array) -> np.ndarray:
        return self.read_all(vectors.to_pylist())

    def read_all(self, vectors: Iterable[bytes]) -> np.ndarray:
        joined = b"".join(vectors)
        return np.frombuffer(joined, self.stored).reshape(-1, self.width).astype(self.exact())

    def beyond(self, norms: np.ndarray) -> np.ndarray:
        """The coordinate that puts vectors of these squared lengths on the sphere."""
        return np.sqrt(np.maximum(0.0, self.most - norms.astype("f8")))


def usable(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): rows that take part, with whole components and moved labels."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = table.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("int").alias("label"),
        F.when(fine, whole).alias("v"),
    ).filter("label IS NOT NULL AND v IS NOT NULL")
    moved = F.when(F.col("id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return found.withColumn("label", moved)


def _packed(rows: DataFrame, space: Space) -> DataFrame:
    """ROWS: vectors as bytes of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
            full = np.zeros((batch.num_rows, space.width), "i8")
            full[np.arange(space.width) < sizes[:, None]] = lists.flatten().to_numpy()
            norms = (full * full).sum(1)
            stored = full.astype(space.stored)
            made = [batch.column(name) for name in ("row", "id", "label")]
            made += [pa.array(norms), pa.array([x.tobytes() for x in stored], pa.binary())]
            yield pa.record_batch(made, ["row", "id", "label", "norm", "v"])

    return rows.mapInArrow(run, ROWS)


@dataclass
class Split:
    """A node: split points, their children (a node, or a leaf as -1 - leaf), and ranges.

    ``nearest[i, j]`` and ``farthest[i, j]`` bound the distances of the rows of child j from
    split point i.
    """

    points: np.ndarray
    beyond: np.ndarray
    children: list[int]
    nearest: np.ndarray = field(default=None)
    farthest: np.ndarray = field(default=None)


class Tree:
    """A multiway hyperplane tree; without splits it is the one leaf 0."""

    def __init__(self, space: Space, sample: np.ndarray, norms: np.ndarray) -> None:
        self.space, self.splits, self.n_leaves = space, [], 0
        self._grow(sample, space.beyond(norms), 0)
        self.no_ranges()

    def no_ranges(self) -> None:
        for split in self.splits:
            ways = len(split.children)
            split.nearest = np.full((ways, ways), np.inf)
            split.farthest = np.full((ways, ways), -np.inf)

    def _distances(self, rows, beyond, split) -> np.ndarray:
        """Of rows on the sphere (anchors: ``beyond`` None, and lengths added by the caller)."""
        products = (rows @ split.points.T).astype("f8")
        return np.sqrt(np.maximum(0.0, 2.0 * (self.space.most - products - np.outer(beyond, split.beyond))))

    def _grow(self, rows: np.ndarray, beyond: np.ndarray, depth: int) -> int:
        """The number of the node made of these rows of the sample."""
        split = self._split(rows, beyond) if len(rows) > LEAF_SAMPLE and depth < DEEPEST else None
        if split is None:
            self.n_leaves += 1
            return -self.n_leaves
        at = len(self.splits)
        self.splits.append(split)
        child_of = self._distances(rows, beyond, split).argmin(1)
        for way in range(len(split.points)):
            mine = child_of == way
            split.children.append(self._grow(rows[mine], beyond[mine], depth + 1))
        return at

    def _split(self, rows: np.ndarray, beyond: np.ndarray) -> Split | None:
        """Of the first 3 * WAYS rows, those that are farthest from the ones taken before."""
        some, of_some = rows[: 3 * WAYS], beyond[: 3 * WAYS]
        products = (some @ some.T).astype("f8") + np.outer(of_some, of_some)
        apart = np.maximum(0.0, self.space.most - products)
        chosen = [0]
        while len(chosen) < WAYS:
            closest = apart[:, chosen].min(1)
            if closest.max() <= ROOM * self.space.most:
                break
            chosen.append(int(closest.argmax()))
        if len(chosen) < 2:
            return None
        return Split(some[chosen], of_some[chosen], [])

    def place(self, rows: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """The leaf of each row; widens the ranges on the way."""
        leaves = np.zeros(len(rows), "i4")
        stack = [(0, np.arange(len(rows)))] if self.splits else []
        while stack:
            at, members = stack.pop()
            split = self.splits[at]
            apart = self._distances(rows[members], beyond[members], split)
            child_of = apart.argmin(1)
            for way, child in enumerate(split.children):
                mine = child_of == way
                if not mine.any():
                    continue
                split.nearest[:, way] = np.minimum(split.nearest[:, way], apart[mine].min(0))
                split.farthest[:, way] = np.maximum(split.farthest[:, way], apart[mine].max(0))
                if child < 0:
                    leaves[members[mine]] = -1 - child
                else:
                    stack.append((child, members[mine]))
        return leaves

    def reached(self, anchors: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: whether a leaf may hold rows with a score in one of the windows.

        ``low`` and ``high`` [anchor, window] bound the scores; a window with low > high is none.
        """
        most, room = float(self.space.most), ROOM * np.sqrt(self.space.most + 1.0)
        base = most + norms.astype("f8")[:, None]
        inner = np.sqrt(np.maximum(0.0, base - 2.0 * high)) - room
        outer = np.sqrt(np.maximum(0.0, base - 2.0 * low)) + room
        wanted = (low <= high) & (base - 2.0 * low >= 0)
        found = np.zeros((len(anchors), max(self.n_leaves, 1)), bool)
        if not self.splits:
            found[:] = wanted.any(1)[:, None]
            return found
        stack = [(0, np.arange(len(anchors)), wanted)]
        while stack:
            at, members, live = stack.pop()
            split = self.splits[at]
            products = (anchors[members] @ split.points.T).astype("f8")
            apart = np.sqrt(np.maximum(0.0, base[members] - 2.0 * products))[:, None, :]
            a, b = inner[members][:, :, None], outer[members][:, :, None]
            # Distances from each split point that rows of the annulus can have.
            least, greatest = np.maximum(apart - b, a - apart), apart + b
            for way, child in enumerate(split.children):
                meets = (least <= split.farthest[:, way]) & (greatest >= split.nearest[:, way])
                still = live & meets.all(2)
                mine = still.any(1)
                if not mine.any():
                    continue
                if child < 0:
                    found[members[mine], -1 - child] = True
                else:
                    stack.append((child, members[mine], still[mine]))
        return found


def best_in_windows(
    scores: np.ndarray,
    allowed: np.ndarray,
    ids: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, column) of the k best allowed scores of each anchor's windows.

    The columns of ``scores[anchor, column]`` come in the order of ``ids``, which settles ties.
    """
    some = low <= high
    least = np.where(some, low, np.inf).min(1, initial=np.inf)
    greatest = np.where(some, high, -np.inf).max(1, initial=-np.inf)
    anchor, column = np.nonzero(allowed & (scores >= least[:, None]) & (scores <= greatest[:, None]))
    values = scores[anchor, column]
    order = np.lexsort((column, -values, anchor))
    anchor, column, values = anchor[order], column[order], values[order]
    found = []
    for window in range(low.shape[1]):
        inside = np.flatnonzero((values >= low[anchor, window]) & (values <= high[anchor, window]))
        of_inside = anchor[inside]
        first = np.searchsorted(of_inside, of_inside)
        taken = inside[np.arange(len(inside)) - first < k]
        found.append((anchor[taken], np.full(len(taken), window), column[taken]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """low and high [anchor, window] of arrays of structs, filled up with windows of no score."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=0)
    low, high = np.full((len(lists), width), np.inf), np.full((len(lists), width), -np.inf)
    for at, windows in enumerate(lists):
        for n, window in enumerate(windows):
            low[at, n], high[at, n] = window["low"], window["high"]
    return low, high


class Mine:
    """The indexed rows of a table of embeddings."""

    def __init__(self, table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"):
        # Numbers are stored with the rows: a task that is repeated later cannot change them.
        taken = usable(table, key, vector, label)
        raw = materialize(taken.withColumn("row", F.monotonically_increasing_id()), "embeddings")
        largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
        self.n_rows, width, most = raw.agg(F.count("*"), F.max(F.size("v")), F.max(largest)).first()
        width, most = max(width or 0, 1), most or 0
        if most * most * width >= 2**62:
            raise ValueError("vectors are too long for whole inner products of 64 bits")
        stored = next(kind for kind in ("<i2", "<i4", "<i8") if most < np.iinfo(kind).max)
        self.rows = materialize(_packed(raw, Space(width, stored, 0)), "vectors")
        longest = self.rows.agg(F.max("norm")).first()[0]
        self.space = Space(width, stored, longest or 0)
        self._fit()
        self._place()

    def _fit(self) -> None:
        """The sample, with rows in the order of their ids, and the tree made of it."""
        mixed = F.xxhash64("v", "id", "row")
        share = 4 * SAMPLE_ROWS / max(self.n_rows, 1)
        few = self.rows if share >= 1 else self.rows.filter(mixed < int((2 * share - 1) * 2**63))
        some = few.orderBy(mixed, "row").limit(SAMPLE_ROWS).toArrow()
        some = some.set_column(1, "id", some["id"].fill_null(LAST_ID))
        norms = some["norm"].to_numpy()
        vectors = self.space.read(some["v"])
        self.tree = Tree(self.space, vectors, norms)
        order = np.lexsort((some["row"].to_numpy(), some["id"].to_numpy()))
        self.sample = {name: some[name].to_numpy()[order] for name in ("row", "id", "label")}
        self.sample["v"] = vectors[order]

    def _place(self) -> None:
        """All rows in their leaves and pieces, and the tree's ranges over all rows."""
        space, tree = self.space, self.tree

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                beyond = space.beyond(batch.column("norm").to_numpy())
                leaves = tree.place(space.read(batch.column("v")), beyond)
                kept = [batch.column(name) for name in ("row", "id", "label", "v")]
                yield pa.record_batch([*kept, pa.array(leaves)], ["row", "id", "label", "v", "leaf"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree.no_ranges()
            for batch in batches:
                beyond = space.beyond(batch.column("norm").to_numpy())
                tree.place(space.read(batch.column("v")), beyond)
            rows = [
                (at, i, j, split.nearest[i, j], split.farthest[i, j])
                for at, split in enumerate(tree.splits)
                for i, j in np.argwhere(split.nearest < np.inf)
            ]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            names = ["node", "i", "j", "nearest", "farthest"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        vectors = self.rows
        if tree.splits:
            schema = "node int, i int, j int, nearest double, farthest double"
            found = vectors.mapInArrow(ranges, schema).groupBy("node", "i", "j")
            # As many rows as the tree has pairs of siblings.
            for row in found.agg(F.min("nearest"), F.max("farthest")).collect():
                tree.splits[row[0]].nearest[row[1], row[2]] = row[3]
                tree.splits[row[0]].farthest[row[1], row[2]] = row[4]
        self.placed = materialize(vectors.mapInArrow(placed, PLACED), "placed")
        sizes = self.placed.groupBy("leaf").agg(F.count("*").alias("rows"))
        self.pieces = materialize(
            sizes.select("leaf", F.ceil(F.col("rows") / PIECE_ROWS).alias("pieces")), "leaves"
        )

    def anchors(self, every: int = ANCHOR_EVERY) -> DataFrame:
        return self.rows.filter(F.col("id") % every == 0)

    def search(self, anchors: DataFrame, same: bool, k: int, n_anchors: int) -> DataFrame:
        """FOUND: the k best rows in each window of anchors(row, id, label, norm, v, windows).

        Rows of the anchor's label with ``same``, else of other labels; never the anchor itself.
        ``windows`` is an array of (low, high); ``n`` of the result counts them from 0.
        """
        space, tree, sample = self.space, self.tree, self.sample
        routed_schema = "row long, label int, v binary, windows array<struct<low: long, high: long>>, leaf int"

        def fitting(labels: np.ndarray, rows: np.ndarray, of_labels: np.ndarray, of_rows: np.ndarray) -> np.ndarray:
            equal = labels[:, None] == of_labels
            return (equal if same else ~equal) & (rows[:, None] != of_rows)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, TILE_SCORES // max(len(sample["row"]), 1))
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    vectors = space.read(batch.column("v"))
                    low, high = _windows(batch.column("windows"))
                    rows, labels = (batch.column(x).to_numpy() for x in ("row", "label"))
                    scores = vectors @ sample["v"].T
                    allowed = fitting(labels, rows, sample["label"], sample["row"])
                    anchor, window, column = best_in_windows(scores, allowed, sample["id"], low, high, k)
                    # Where the sample fills a window, only rows as good as its last matter.
                    full = np.zeros(low.shape, "i8")
                    np.add.at(full, (anchor, window), 1)
                    worst = np.full(low.shape, np.inf)
                    np.minimum.at(worst, (anchor, window), scores[anchor, column])
                    low = np.where(full >= k, np.maximum(low, worst), low)
                    at, leaf = np.nonzero(tree.reached(vectors, batch.column("norm").to_numpy(), low, high))
                    windows = [
                        [{"low": int(a), "high": int(b)} for a, b in zip(*pair) if a < np.inf]
                        for pair in zip(low, high)
                    ]
                    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
                    made = [batch.column(x) for x in ("row", "label", "v")] + [pa.array(windows, kind)]
                    taken = [column.take(pa.array(at)) for column in made]
                    names = ["row", "label", "v", "windows", "leaf"]
                    yield pa.record_batch([*taken, pa.array(leaf, pa.int32())], names)

        def searched(rows: pa.Table, wanted: pa.Table) -> pa.Table:
            found = [[] for _ in range(5)]
            ids = rows["id"].fill_null(LAST_ID).to_numpy()
            order = np.lexsort((rows["row"].to_numpy(), ids))
            rows, ids = rows.take(pa.array(order)), ids[order]
            of_rows, of_labels = rows["row"].to_numpy(), rows["label"].to_numpy()
            vectors = space.read(rows["v"]) if len(order) else None
            step = max(1, TILE_SCORES // max(len(order), 1))
            for start in range(0, wanted.num_rows if len(order) else 0, step):
                some = wanted.slice(start, step)
                low, high = _windows(some["windows"])
                of_some, labels = some["row"].to_numpy(), some["label"].to_numpy()
                scores = space.read(some["v"]) @ vectors.T
                allowed = fitting(labels, of_some, of_labels, of_rows)
                anchor, window, column = best_in_windows(scores, allowed, ids, low, high, k)
                parts = (of_some[anchor], window, of_rows[column], column, scores[anchor, column])
                for values, part in zip(found, parts):
                    values.append(part)
            joined = [np.concatenate(part) if part else np.zeros(0, "i8") for part in found]
            id_of = rows["id"].combine_chunks().take(pa.array(joined[3].astype("i8")))
            made = [
                pa.array(joined[0], pa.int64()),
                pa.array(joined[1], pa.int32()),
                pa.array(joined[2], pa.int64()),
                id_of,
                pa.array(joined[4].astype("i8"), pa.int64()),
            ]
            return pa.table(made, ["anchor", "n", "row", "id", "score"])

        blocks = n_anchors // BLOCK_ANCHORS + 1
        every_piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        pieces = F.broadcast(self.pieces)  # a row for each leaf of the tree
        place = ["leaf", "piece", "block"]
        wanted = (
            anchors.mapInArrow(routed, routed_schema)
            .join(pieces, "leaf")
            .withColumn("piece", every_piece)
            .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
            .drop("pieces")
        )
        rows = (
            self.placed.join(pieces, "leaf")
            .withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")))
            .withColumn("block", every_block)
            .drop("pieces")
        )
        found = rows.groupBy(*place).cogroup(wanted.groupBy(*place)).applyInArrow(searched, FOUND)
        best = Window.partitionBy("anchor", "n").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = ANCHOR_EVERY,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    mine = Mine(table, key, vector, label)
    anchors = materialize(mine.anchors(every), "anchors")
    n_anchors = anchors.count()
    # No score lies beyond the largest squared length.
    reach = F.struct(F.lit(-mine.space.most).alias("low"), F.lit(mine.space.most).alias("high"))
    all_scores = F.array(reach.cast("struct<low: long, high: long>"))
    positives = materialize(
        mine.search(anchors.withColumn("windows", all_scores), True, N_POSITIVES, n_anchors), "positives"
    )
    hundred = F.lit(100).cast("long")
    low = F.call_function("div", F.col("score") * LEAST_SHARE + 99, hundred)
    window = F.struct("rank", low.alias("low"), F.col("score").alias("high"))
    windows = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(window)).alias("windows"))
    plain = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high")))
    asked = anchors.join(windows.withColumn("windows", plain), "row")
    negatives = mine.search(asked, False, N_NEGATIVES, n_anchors)
    of_positives = positives.select(
        "anchor",
        (F.col("rank") - 1).alias("n"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    anchor_ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(of_positives, ["anchor", "n"])
        .join(anchor_ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
