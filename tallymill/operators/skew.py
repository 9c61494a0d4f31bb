"""Joins that stay even when one key holds a large share of the rows.

Where each key occurs once on one side, Spark's adaptive execution splits a crowded key by
itself. Where a key may occur often on both sides, splitting one side is not enough: here
both are cut, by the number of rows times the number of their partners.

Each pair of cuts is joined by itself, so each row is copied for each cut of its partners.
Where the result grows with the square of the tables, so would the copies: `listing_join`
makes larger cuts for a larger result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import materialize

#: A task joins about the square of this many pairs of rows of one key.
ROWS_PER_SIDE = 1_000

#: The same where the whole result is listed, if it is large. A task holds this many rows.
MOST_PER_SIDE = 32_768

#: So many pairs of cuts fall to a task of a listing, which evens out their sizes.
CUTS_PER_TASK = 8


def key_sizes(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, rows)"""
    return df.groupBy(*on).agg(F.count("*").alias("rows"))


def key_cuts(
    left_sizes: DataFrame, right_sizes: DataFrame, on: Sequence[str], rows_per_side: int | None = None
) -> DataFrame:
    """(*on, left_cuts, right_cuts) of keys with more pairs than one task should join.

    A side with few rows is not cut; the other is then cut by the number of pairs. So the
    cuts of a key, and the copies they cost, grow no faster than its result.
    """
    side = rows_per_side or ROWS_PER_SIDE
    both = left_sizes.select(*on, F.col("rows").alias("n_left")).join(
        right_sizes.select(*on, F.col("rows").alias("n_right")), list(on)
    )

    def cuts(own: str, other: str) -> Column:
        rows = F.greatest(F.lit(float(side)), F.lit(side * side) / F.col(other))
        return F.ceil(F.col(own) / rows).cast("long")

    found = both.select(
        *on,
        cuts("n_left", "n_right").alias("left_cuts"),
        cuts("n_right", "n_left").alias("right_cuts"),
    )
    return found.filter("left_cuts > 1 OR right_cuts > 1")


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_sizes: DataFrame | None = None,
    right_sizes: DataFrame | None = None,
    rows_per_side: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Inner equi-join that deals the pairs of a crowded key to several tasks.

    Each row gets a number on its own side and is repeated for each number of the other
    side, so two rows of a key meet exactly once. The number includes the input partition,
    which stays the same when a task is repeated: copies of one row are spread as well.

    Sizes (*on, rows) may be given where they are known; they may be too large. Else both
    sides are counted first, so they should be stored tables. The cuts are stored: Spark
    knows their size when it joins them.

    With ``tasks`` the join is a merge join of so many tasks, whatever the size of its sides.
    """
    of_left = key_sizes(left, on) if left_sizes is None else left_sizes
    of_right = key_sizes(right, on) if right_sizes is None else right_sizes
    cut = materialize(key_cuts(of_left, of_right, on, rows_per_side), "cuts")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*df.columns, F.spark_partition_id())
        numbered = df.withColumn("_row", row).join(cut, list(on), "left")
        mine = F.pmod("_row", F.coalesce(f"{own}_cuts", F.lit(1).cast("long")))
        theirs = F.coalesce(f"{other}_cuts", F.lit(1).cast("long")) - 1
        return (
            numbered.withColumn(f"_{own}", mine)
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), theirs)))
            .drop("_row", "left_cuts", "right_cuts")
        )

    key = [*on, "_left", "_right"]
    sides = [dealt(left, "left", "right"), dealt(right, "right", "left")]
    if tasks is not None:
        sides = [side.repartition(tasks, *key).hint("merge") for side in sides]
    return sides[0].join(sides[1], key).drop("_left", "_right")


def listing_side(pairs: float, partitions: int) -> tuple[int, int]:
    """Rows per side, and tasks, of a join that makes so many pairs in so many partitions at most.

    Up to ``MOST_PER_SIDE`` a side grows with the root of the pairs, so that the cuts, and the
    copies of a row, do not grow with the tables.
    """
    least = ROWS_PER_SIDE * ROWS_PER_SIDE
    side = math.isqrt(int(pairs / (CUTS_PER_TASK * partitions)))
    tasks = min(partitions, math.ceil(pairs / least))
    return max(ROWS_PER_SIDE, min(side, MOST_PER_SIDE)), max(1, tasks)


def listing_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_sizes: DataFrame, right_sizes: DataFrame
) -> DataFrame:
    """`balanced_join` for a result that is far larger than both sides.

    Spark plans tasks by the bytes they read, which say little here: their number follows from
    the pairs. So many also make the copies of the left side, which may be a small file. A row
    of the left side meets all of its partners of a cut in turn.
    """
    sizes = left_sizes.select(*on, F.col("rows").alias("n")).join(right_sizes, list(on))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("rows"))).first()[0] or 0
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side, tasks = listing_side(pairs, partitions)
    return balanced_join(left.repartition(tasks), right, on, left_sizes, right_sizes, side, tasks)
