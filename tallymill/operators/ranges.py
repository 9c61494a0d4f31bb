"""Stretches of days of any length, put together from sums that stand ready.

Days are numbered, and a node (level, number) covers 2^level days that begin at a multiple of
their number. A stretch of days is the union of at most two nodes of each level. Sums are kept
per node, so what lies in a stretch is found by an equi-join on its nodes, never by comparing
dates with bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The node of all rows, those of unknown date included.
EVERYTHING = -1
NODE = ["level", "node"]


def _node(level: Column, node: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), node.cast("long").alias("node"))


def nodes_between(first: Column, last: Column, top: int) -> Column:
    """Array of the nodes that make up the days from ``first`` to ``last``, both included.

    ``top`` is a level of which a node covers more days than any stretch asked for.
    """
    found = []
    for level in range(top + 1):
        size = F.lit(1 << level).cast("long")
        # Nodes of the level that lie in the stretch as a whole are begin .. end - 1. Of these
        # only the outer ones are not part of a node of the next level.
        begin, end = F.ceil(first / size), F.floor((last + 1) / size)
        some = begin < end
        found.append(F.when(some & (F.pmod(begin, F.lit(2)) == 1), _node(F.lit(level), begin)))
        found.append(F.when(some & (F.pmod(end, F.lit(2)) == 1), _node(F.lit(level), end - 1)))
    return F.array_compact(F.array(*found))


def nodes_above(day: Column, top: int) -> Column:
    """Array of the nodes that a day lies in; an unknown day lies in that of all rows only."""
    levels = [_node(F.lit(level), F.floor(day / F.lit(1 << level))) for level in range(top + 1)]
    every = _node(F.lit(EVERYTHING), F.lit(0))
    return F.when(day.isNull(), F.array(every)).otherwise(F.array(every, *levels))


def days_of(cells: DataFrame) -> tuple[int | None, int | None]:
    """Numbers of the first and the last day of a table with ``date``."""
    day = F.unix_date("date")
    return tuple(cells.agg(F.min(day), F.max(day)).first())


def top_level(days: tuple[int | None, int | None]) -> int:
    first, last = days
    return 0 if first is None else (last - first + 1).bit_length()


def nodes_of_ranges(ranges: DataFrame, days: tuple[int | None, int | None]) -> DataFrame:
    """(window, level, node) of ranges(window, first_day, last_day).

    A bound that is null is open. Without any bound a range is all rows, also those of unknown
    date. Ranges are first cut to the days there are.
    """
    first, last = (F.lit(day).cast("long") for day in days)
    begin = F.greatest(F.coalesce(F.unix_date("first_day").cast("long"), first), first)
    end = F.least(F.coalesce(F.unix_date("last_day").cast("long"), last), last)
    whole = F.col("first_day").isNull() & F.col("last_day").isNull()
    nodes = F.when(whole, F.array(_node(F.lit(EVERYTHING), F.lit(0)))).otherwise(
        nodes_between(begin, end, top_level(days))
    )
    return ranges.select("window", F.explode(nodes).alias("of")).select("window", "of.*")


def day_cells(txns: DataFrame, weight: str | None = None) -> DataFrame:
    """(date, category, merchant, amount, rows): transactions summed per day and pair.

    ``weight`` names a column that says how many transactions a row stands for.
    """

    def filled(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")).alias(column)

    rows = F.sum(weight) if weight else F.count("*")
    return txns.groupBy("date", filled("category"), filled("merchant")).agg(
        F.sum("amount").alias("amount"), rows.alias("rows")
    )


def node_cells(cells: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """(level, node, category, merchant, amount, rows) of the ``wanted`` (level, node)."""
    in_nodes = F.explode(nodes_above(F.unix_date("date"), top)).alias("of")
    dealt = cells.select(in_nodes, "category", "merchant", "amount", "rows").select(
        "of.*", "category", "merchant", "amount", "rows"
    )
    return (
        dealt.join(wanted.select(*NODE).distinct(), NODE, "left_semi")
        .groupBy(*NODE, "category", "merchant")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.sum("rows").alias("rows"))
    )


def rows_in_ranges(txns: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of each range(window, first_day, last_day), with ``window``.

    A row lies in exactly one node of a range that it belongs to.
    """
    days = days_of(txns)
    wanted = nodes_of_ranges(ranges, days)
    in_nodes = F.explode(nodes_above(F.unix_date("date"), top_level(days))).alias("_of")
    row = F.struct(*[F.col(f"`{name}`") for name in txns.columns]).alias("_row")
    dealt = txns.select(row, in_nodes).select("_row", "_of.*")
    return dealt.join(wanted, NODE).select("window", "_row.*")
