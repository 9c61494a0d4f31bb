"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import materialize


def _towards_least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with the least v of each u beside each pair."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component, for all nodes of edges(u, v).

    Large-star and small-star steps in turn: each joins the neighbours of a node to their
    least one. The number of rounds grows with the logarithm of the longest path. Every
    round is stored, so a lost executor costs no earlier round. A node with very many
    neighbours is an aggregate with partial sums and a join that Spark can split.
    """
    now = materialize(
        edges.filter("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _towards_least(both)
            .withColumn("least", F.least("least", "u"))
            .filter("v > u AND v != least")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
        ).distinct()
        # Here v < u for all pairs: small-star joins each u and its neighbours to the least.
        small = _towards_least(large)
        now = materialize(
            small.select("u", F.col("least").alias("v"))
            .unionByName(small.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")))
            .distinct(),
            "edges",
        )
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
