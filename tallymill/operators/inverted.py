"""Vector search in inverted lists, with a measured recall or, by distance bounds, exact.

The vectors of an index are dealt into lists around centroids, which k-means finds over all of
them. A query looks into the lists of its nearest centroids. How many these must be for a
recall that is asked for is measured on some queries against the exact search.

Distances are those of vectors of length one, so the triangle inequality bounds them: a row of
a list is no nearer to a query than its centroid is, less the row's own distance from it. Once
a query has k rows, that rules out whole lists and, in the others, all rows too close to the
centroid or too far from it. What is left over is searched too if the result shall be exact.

Similarities, ties and vectors without direction are as in :mod:`~tallymill.operators.retrieval`,
whose exact scan stays the default. As there, the queries are stored and stream past the lists;
rows of the index are held in groups of bounded size, whatever the size of a list. Centroids are
at most ``MOST_LISTS`` vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.vectors import has_length
from tallymill.operators.nearest import TILE, Best, id_ranks, ranked, unit_rows
from tallymill.operators.retrieval import (
    BLOCK_VALUES,
    GROUP_VALUES,
    TOP_K,
    groups_of,
    one_dimension,
    stored_blocks,
    top_k,
    without_similarity,
)
from tallymill.session import discard, materialize

MOST_LISTS = 4_096
LISTS_PER_ROOT = 2.0
#: Rounds of k-means over all rows.
ROUNDS = 5
#: Queries on which the number of lists is measured.
SAMPLE_QUERIES = 256
RECALL = 0.95
#: Distances are compared with this much room for rounding.
ROOM = 1e-6


@dataclass(frozen=True)
class Lists:
    """An index(id, embedding) in lists; ``rows`` adds list and distance from its centroid."""

    index: DataFrame
    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray


def _tiles_of(batch: pd.DataFrame) -> Iterator[np.ndarray]:
    """The vectors of a batch, at most ``TILE`` at a time: each meets all centroids."""
    for at in range(0, len(batch), TILE):
        yield unit_rows(batch["embedding"].iloc[at : at + TILE])


def _packed_sums(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(list, rows, summed vectors) of all rows by their nearest centroid.

    Each task sums its rows, Spark the sums of the tasks: one row per list reaches the driver.
    """
    schema = "list int, rows long, total binary"

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, rows = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for units in _tiles_of(batch):
                nearest = (units @ centroids.T).argmax(1)
                np.add.at(totals, nearest, units)
                rows += np.bincount(nearest, minlength=len(rows))
        used = np.flatnonzero(rows)
        packed = [totals[at].tobytes() for at in used]
        yield pd.DataFrame({"list": used.astype(np.int32), "rows": rows[used], "total": packed})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(part) for part in group["total"])
        return pd.DataFrame(
            {"list": group["list"][:1], "rows": [group["rows"].sum()], "total": [total.tobytes()]}
        )

    found = vectors.select("embedding").mapInPandas(summed, schema)
    return [tuple(row) for row in found.groupBy("list").applyInPandas(merged, schema).collect()]


def _first_centroids(vectors: DataFrame, lists: int) -> np.ndarray:
    """Vectors of rows taken by hash; equal ones count once."""
    order = F.xxhash64("embedding")
    some = vectors.select("embedding").distinct().orderBy(order).limit(lists).toPandas()
    return unit_rows(some["embedding"])


def fit_lists(index: DataFrame, lists: int | None = None, rounds: int = ROUNDS) -> Lists:
    """Deal index(id, embedding) into lists; by default about twice the root of its rows."""
    stored = materialize(index.select("id", "embedding"), "index")
    vectors = materialize(stored.filter(has_length(F.col("embedding"))), "vectors")
    n = vectors.count()
    one_dimension(vectors.withColumnRenamed("id", "query_id").limit(0), vectors)
    wanted = lists or round(LISTS_PER_ROOT * math.sqrt(n))
    if not n:
        empty = vectors.select("*", F.lit(0).alias("list"), F.lit(0.0).alias("apart"))
        return Lists(stored, empty, np.zeros((0, 0)), np.zeros(0))
    centroids = _first_centroids(vectors, max(1, min(wanted, MOST_LISTS)))
    for _ in range(rounds):
        moved = centroids.copy()
        for at, _, total in _packed_sums(vectors, centroids):
            mean = np.frombuffer(total)
            length = np.linalg.norm(mean)
            if length > 0:
                moved[at] = mean / length
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    schema = T.StructType([*vectors.schema.fields]).add("list", T.IntegerType()).add("apart", T.DoubleType())

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists_of, apart = [], []
            for units in _tiles_of(batch):
                near = units @ centroids.T
                lists_of.append(near.argmax(1).astype(np.int32))
                apart.append(_distance(near[np.arange(len(near)), lists_of[-1]]))
            if lists_of:
                yield batch.assign(list=np.concatenate(lists_of), apart=np.concatenate(apart))

    dealt = vectors.mapInPandas(placed, schema)
    # A list may be any share of the rows: it is cut within by distance.
    order = ["list", "apart", F.xxhash64("id", "embedding")]
    rows = materialize(dealt.repartitionByRange(*order).sortWithinPartitions("list", "apart"), "lists")
    radii = np.full(len(centroids), -1.0)
    for at, radius in rows.groupBy("list").agg(F.max("apart")).collect():
        radii[at] = radius
    discard(vectors)
    return Lists(stored, rows, centroids, radii)


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * similarity))


def _nearest_lists(near: np.ndarray, probes: int) -> np.ndarray:
    """[query, list]: whether a list is among the nearest ones."""
    found = np.zeros(near.shape, bool)
    if probes >= near.shape[1]:
        found[:] = True
    else:
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(found, order, True, axis=1)
    return found


def _segments(lists: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(list, start, end) of the runs of one list with rising distances."""
    begins = (lists[1:] != lists[:-1]) | (apart[1:] < apart[:-1])
    starts = np.flatnonzero(np.concatenate(([True], begins)))
    for start, end in zip(starts, [*starts[1:], len(lists)]):
        yield int(lists[start]), int(start), int(end)


def queries_at_once(lists: int, dimensions: int) -> int:
    """Queries of a block, which meets a tile of rows, and all centroids, as one matrix."""
    return min(TILE, BLOCK_VALUES // max(dimensions, lists, 1) + 1)


def _scan(queries: DataFrame, lists: Lists, k: int, probes: int, rest: bool) -> DataFrame:
    """Candidates from the nearest lists, or with ``rest`` from those that bounds leave over.

    ``queries`` is stored; with ``rest`` its ``reach`` is the distance of the k-th row found.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", lists.rows.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    centroids, radii, uris = lists.centroids, lists.radii, sorted(queries.inputFiles())
    per_block = queries_at_once(*centroids.shape)

    def within_reach(block, apart_of_list, apart, start, end, mine):
        """The rows of one list that bounds leave to the queries ``mine`` of a block."""
        reach = block["reach"].to_numpy()[mine]
        near, far = (apart_of_list[mine] - reach).min() - ROOM, (apart_of_list[mine] + reach).max() + ROOM
        inside = apart[start:end]
        return start + np.searchsorted(inside, near), start + np.searchsorted(inside, far, "right")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups_of(batches, GROUP_VALUES):
            ids, apart_of_row = frame["id"].to_numpy(), frame["apart"].to_numpy()
            units, ranks = unit_rows(frame["embedding"]), id_ranks(ids)
            segments = list(_segments(frame["list"].to_numpy(), apart_of_row))
            for block in stored_blocks(uris, per_block):
                wanted = unit_rows(block["embedding"])
                near = wanted @ centroids.T
                asked, apart = _nearest_lists(near, probes), _distance(near)
                if rest:
                    within = apart - radii <= block["reach"].to_numpy()[:, None] + ROOM
                    asked = within & ~asked
                best = Best(wanted, units, ranks, k)
                for at, start, end in segments:
                    mine = np.flatnonzero(asked[:, at])
                    if len(mine) and rest:
                        start, end = within_reach(block, apart[:, at], apart_of_row, start, end, mine)
                    if len(mine):
                        best.look(start, end, mine)
                yield best.found(block["query_id"].to_numpy(), ids)

    return lists.rows.select("id", "embedding", "list", "apart").mapInPandas(scan, schema)


def search(
    queries: DataFrame, lists: Lists, k: int = TOP_K, probes: int = 1, exact: bool = False
) -> DataFrame:
    """(query_id, id, rank, similarity) for queries(query_id, embedding).

    Looks into the ``probes`` nearest lists, and with ``exact`` into whatever distance bounds
    leave over, which makes the result that of the exact search.
    """
    stored = materialize(queries.select("query_id", "embedding"), "queries")
    wanted = materialize(stored.filter(has_length(F.col("embedding"))), "queries")
    flat = without_similarity(stored, lists.index, k)
    if not len(lists.centroids):
        return ranked(flat, k)
    one_dimension(wanted, lists.rows)
    first = materialize(_scan(wanted, lists, k, probes, False), "candidates")
    if not exact:
        return ranked(first.unionByName(flat), k)
    kth = ranked(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("kth"))
    reach = F.when(F.col("n") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth")))).otherwise(2.0)
    bounded = wanted.join(kth, "query_id", "left").select(
        "query_id", "embedding", F.coalesce(reach, F.lit(2.0)).alias("reach")
    )
    rest = _scan(materialize(bounded, "queries"), lists, k, probes, True)
    return ranked(first.unionByName(rest).unionByName(flat), k)


def probes_for(
    queries: DataFrame, lists: Lists, k: int = TOP_K, recall: float = RECALL, sample: int = SAMPLE_QUERIES
) -> int:
    """The fewest lists in which ``recall`` of the k best rows lie, on a sample of the queries.

    The sample is taken by hash and searched exactly.
    """
    if not len(lists.centroids):
        return 1
    asked = queries.select("query_id", "embedding").filter(has_length(F.col("embedding")))
    some = materialize(asked.orderBy(F.xxhash64("query_id", "embedding")).limit(sample), "sample")
    best = top_k(some, lists.index, k).filter("similarity IS NOT NULL").select("query_id", "id")
    # At most k rows for each query of the sample.
    found = best.join(lists.rows.select("id", "list"), "id").join(some, "query_id").toPandas()
    if found.empty:
        return 1
    near = unit_rows(found["embedding"]) @ lists.centroids.T
    order = np.argsort(-near, axis=1, kind="stable")
    at = (order == found["list"].to_numpy()[:, None]).argmax(1)
    return int(np.sort(at)[math.ceil(recall * len(at)) - 1]) + 1


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows(query_id, id) that were found."""
    key = ["query_id", "id"]
    both = exact.select(*key).join(found.select(*key).withColumn("_found", F.lit(1)), key, "left")
    share = both.agg(F.avg(F.coalesce("_found", F.lit(0)))).first()[0]
    return 1.0 if share is None else float(share)
