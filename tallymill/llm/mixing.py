"""Mix sources to target weights by entropy balancing.

Every word of a document starts with rate 1. Among the rates that meet the sources' token
targets, entropy balancing takes those of least relative entropy to the start. Their
convex dual has one multiplier per constraint, and the rates are exponentially tilted:
``exp(multiplier)``, no more than ``MOST_COPIES``. Newton iterations solve the dual. They
are table operations on one row per source, whose sums Spark takes from all documents.

A document's rate then becomes a whole number of copies: in cells of documents of a source,
from the longest to the shortest, each takes the lower or higher neighbour of its rate,
whichever brings the words taken so far closer to the words due. The short documents at
the end settle what the long ones leave open.

Defined cases: a null text has size 0; a null source is a source of its own, the last.
Sources of size 0 take nothing. Documents of size 0 get the lower neighbour of their rate
where the words due are met. Equal rows are interchangeable. Same input, same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import map_slices, row_key, utf8
from tallymill.session import discard, materialize

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
CELL_ROWS = 2_000
STEPS = 60
ACCURACY = 1e-12


def sized(docs: DataFrame, source: str, text: str, carry: Sequence[str]) -> DataFrame:
    """(row, source, key_a, key_b, size): documents with their number of words.

    Without columns to carry there is no ``row``.
    """
    carried = [F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row")] if carry else []
    rows = docs.select(
        *carried,
        F.col(source).cast("string").alias("source"),
        *row_key(docs),
        F.col(text).alias("text"),
    )
    names = rows.columns[:-1]
    schema = StructType([*[rows.schema[name] for name in names]]).add("size", "long", False)

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = [len(value.split()) if value else 0 for value in utf8(batch.column("text"))]
            kept = [batch.column(name) for name in names]
            return pa.record_batch([*kept, pa.array(sizes, pa.int64())], [*names, "size"])

        return work

    return map_slices(rows, schema, factory)


def cyclic_weights(weights: Sequence[float] = WEIGHTS) -> Column:
    """The sources' weights in their order by code point, null last, repeating."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return F.get(F.array(*[F.lit(float(weight)) for weight in weights]), at)


def targets(
    sources: DataFrame, total_share: float = TOTAL_SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """sources(source, source_size, weight) with ``target``.

    The total is shared by weight. A source that would get more than ``most`` times its
    size gets just that, and the rest is shared again. Sources fill up in the order of
    most * size / weight, so it is enough to find how many do.
    """
    cap = most * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.lit(total_share) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum(cap).over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    leveled = sources.withColumn("_level", level).withColumn(
        "_full", F.col("_level") * F.col("weight") >= cap
    )
    # The first source that does not fill up sets the level of all from there on. The level
    # falls from it to later ones, so it has the highest.
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full"), cap.cast("double")).otherwise(common * F.col("weight"))
    return leveled.withColumn("target", target).drop("_level", "_full")


def multipliers(sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """sources(source, source_size, target) with ``rate`` = exp(multiplier), by Newton.

    The dual of a source is size * exp(m) - target * m: its gradient is what the rate takes
    beyond the target, its curvature what the rate takes. Steps are held to 1, which keeps
    the first ones from overshooting. A source at the bound ``most`` stays there.
    """
    solved = sources.withColumn("_m", F.lit(0.0))
    taken = F.col("source_size") * F.exp("_m")
    step = (taken - F.col("target")) / taken
    for _ in range(STEPS):
        held = F.when(taken > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
        solved = materialize(
            solved.withColumn("_m", F.col("_m") - F.coalesce(held, F.lit(0.0))), "multipliers"
        )
        (off,) = solved.agg(
            F.max(F.when(F.col("target") > 0, F.abs(taken - F.col("target")) / F.col("target")))
        ).first()
        if off is None or off <= ACCURACY:
            break
    else:
        raise RuntimeError(f"the multipliers are off by {off} of a target after {STEPS} steps")
    rate = F.least(F.lit(float(most)), F.exp("_m"))
    return solved.withColumn("rate", F.when(F.col("target") > 0, rate).otherwise(0.0)).drop("_m")


def copies_of(sizes: np.ndarray, rate: float) -> np.ndarray:
    """Whole copies of documents in their order, keeping the words taken close to those due."""
    low = int(np.floor(rate + 1e-9))
    if rate - low < 1e-9:
        return np.full(len(sizes), low)
    copies, behind, part = [], 0.0, rate - low
    for size in sizes.tolist():
        behind += part * size
        more = behind > size / 2
        behind -= size * more
        copies.append(low + more)
    return np.array(copies, np.int64)


def copies_of_equal(sizes: np.ndarray, counts: np.ndarray, rate: float) -> np.ndarray:
    """Copies of groups of equal documents: the sum of what :func:`copies_of` gives to each.

    The words behind stay within half a document of the size at hand, once they are there, so
    the number of higher neighbours in a group follows from where it begins.
    """
    low = int(np.floor(rate + 1e-9))
    if rate - low < 1e-9:
        return low * counts
    copies, behind, part = [], 0.0, rate - low
    for size, count in zip(sizes.tolist(), counts.tolist()):
        if size:
            more = min(count, max(0, math.ceil(behind / size + count * part - 0.5)))
            behind += (count * part - more) * size
        else:
            more = count if behind > 0 else 0
        copies.append(low * count + more)
    return np.array(copies, np.int64)


def _rates(rows: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """(source, source_size, source_rows, target, rate, ..) of rows(source, size), stored."""
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    weighted = sources.withColumn("weight", cyclic_weights(weights))
    return materialize(multipliers(materialize(targets(weighted, total_share, most), "targets"), most), "rates")


def _in_cells(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with what is known of their source, and a cell of the source."""
    placed = rows.join(
        rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    cells = (F.col("source_rows") / CELL_ROWS).cast("long") + 1
    return placed.withColumn("cell", F.pmod(F.xxhash64("key_a", "key_b"), cells))


CELL_ORDER = [("size", "descending"), ("key_a", "ascending"), ("key_b", "ascending")]


def mixed(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    carry: Sequence[str] | None = None,
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """(row, size, source_size, target, rate, copies) for each document.

    ``row`` is a struct of the carried columns (all by default). A source is dealt into
    cells of about ``CELL_ROWS`` documents, so the largest source is rounded by many tasks.
    """
    rows = materialize(sized(docs, source, text, carry or docs.columns), "sizes")
    placed = _in_cells(rows, _rates(rows, weights, total_share, most))
    names = ["row", "size", "source_size", "target", "rate"]
    schema = StructType([placed.schema[name] for name in names]).add("copies", "long")

    def rounded(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by(CELL_ORDER)
        copies = copies_of(cell["size"].to_numpy(), cell["rate"][0].as_py())
        return cell.select(names).append_column("copies", pa.array(copies, pa.int64()))

    return placed.groupBy("source", "cell").applyInArrow(rounded, schema)


def resampled(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say.

    Copies are settled for the rows' keys alone; texts meet them once. Equal rows are one key
    with a count, and come from one of them, so no group of copies is held by a task.
    """
    rows = materialize(sized(docs, source, text, ()), "sizes")
    rates = _rates(rows, WEIGHTS, TOTAL_SHARE, MOST_COPIES)
    groups = rows.groupBy("source", "key_a", "key_b").agg(
        F.first("size").alias("size"), F.count("*").alias("rows")
    )

    def rounded(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by(CELL_ORDER)
        copies = copies_of_equal(cell["size"].to_numpy(), cell["rows"].to_numpy(), cell["rate"][0].as_py())
        found = cell.select(["key_a", "key_b", "rows"])
        return found.append_column("copies", pa.array(copies, pa.int64()))

    schema = "key_a long, key_b long, rows long, copies long"
    placed = _in_cells(groups, rates).select("source", "cell", "key_a", "key_b", "size", "rows", "rate")
    copies = materialize(placed.groupBy("source", "cell").applyInArrow(rounded, schema), "copies")
    discard(rows)
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    taken = docs.select(whole, *row_key(docs)).join(copies.filter("copies > 0"), ["key_a", "key_b"])

    def repeated(found: DataFrame, times: Column) -> DataFrame:
        return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("row.*")

    single = repeated(taken.filter("rows = 1").select("row", "copies"), F.col("copies"))
    # A group may be any number of rows: it is cut before it is repeated.
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, F.lit(CELL_ROWS))))
    several = taken.filter("rows > 1").select("row", "copies").distinct().withColumn("_part", parts)
    several = several.repartition(F.xxhash64("row"), "_part")
    left = F.least(F.lit(CELL_ROWS).cast("long"), F.col("copies") - CELL_ROWS * F.col("_part"))
    return single.unionByName(repeated(several, left))
