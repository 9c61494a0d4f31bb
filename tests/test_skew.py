import pytest
from pyspark.sql import functions as F

from tallymill.operators import skew
from plan import plan_of
from tallymill.operators.skew import balanced_join, key_cuts, key_sizes, listing_join, listing_side


def sides(spark, n, m):
    """Key 0 holds a third of both sides."""
    left = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k"),
        (F.col("id") % 7).alias("v"),
    )
    right = spark.range(m).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 25).alias("k"),
        (F.col("id") % 5).alias("w"),
    )
    return left.repartition(3), right.repartition(2)


@pytest.mark.parametrize("n, m", [(600, 4), (4, 600), (300, 300), (0, 5), (5, 0)])
def test_balanced_join_equals_plain_join(spark, n, m, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SIDE", 10)
    left, right = sides(spark, n, m)
    joined = balanced_join(left, right, ["k"])
    plain = left.join(right, ["k"])
    assert joined.columns == plain.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_cuts_follow_rows_times_partners(spark):
    def cuts(n, m):
        one = F.lit(1).alias("k")
        sizes = [key_sizes(spark.range(rows).select(one), ["k"]) for rows in (n, m)]
        found = key_cuts(*sizes, ["k"], 10)
        return [(r.left_cuts, r.right_cuts) for r in found.collect()]

    assert cuts(10, 10) == [] and cuts(100, 1) == []
    assert cuts(1000, 1) == [(10, 1)] and cuts(1, 1000) == [(1, 10)]
    assert cuts(1000, 5) == [(50, 1)]
    assert cuts(200, 300) == [(20, 30)]


def test_a_key_crowded_on_both_sides_is_cut_on_both(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SIDE", 20)
    left, right = sides(spark, 900, 600)
    cuts = key_cuts(key_sizes(left, ["k"]), key_sizes(right, ["k"]), ["k"])
    cut = {r.k: (r.left_cuts, r.right_cuts) for r in cuts.collect()}
    assert cut[0][0] >= 15 and cut[0][1] >= 10
    parts = balanced_join(left.withColumn("k", F.lit(0)), right.withColumn("k", F.lit(0)), ["k"])
    assert parts.count() == 900 * 600


def test_copies_of_one_row_are_spread(spark):
    copies = spark.range(0, 4000, 1, 40).select(F.lit(1).alias("k"))
    parts = copies.select(F.pmod(F.xxhash64("k", F.spark_partition_id()), F.lit(4)).alias("s"))
    assert parts.distinct().count() == 4


@pytest.mark.parametrize("n, m", [(600, 4), (4, 600), (300, 300), (0, 5), (5, 0)])
def test_listing_join_equals_plain_join(spark, n, m, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SIDE", 10)
    left, right = sides(spark, n, m)
    joined = listing_join(left, right, ["k"], key_sizes(left, ["k"]), key_sizes(right, ["k"]))
    plain = left.join(right, ["k"])
    assert joined.columns == plain.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_copies_of_a_listing_do_not_grow_with_its_square(spark):
    def copies(n, m):
        sizes = [spark.createDataFrame([(1, rows)], "k int, rows long") for rows in (n, m)]
        side, tasks = listing_side(n * m, 200)
        (cut,) = key_cuts(*sizes, ["k"], side).collect()
        return n * cut.right_cuts + m * cut.left_cuts, tasks

    few, tasks = copies(100_000, 100_000)
    many, more = copies(1_000_000, 1_000_000)
    assert tasks == more == 200
    assert many < 11 * few < 11 * 100 * 200_000
    most, _ = copies(10_000_000, 1_000_000)
    assert most < 2.1 * 10**13 / skew.MOST_PER_SIDE
    assert listing_side(0, 200) == (skew.ROWS_PER_SIDE, 1)


def test_a_listing_has_tasks_by_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SIDE", 10)
    left, right = sides(spark, 300, 300)
    joined = listing_join(left, right, ["k"], key_sizes(left, ["k"]), key_sizes(right, ["k"]))
    assert "SortMergeJoin" in plan_of(joined)
    joined.collect()
    assert "AQEShuffleRead" not in plan_of(joined)
    assert joined.rdd.getNumPartitions() == 4
