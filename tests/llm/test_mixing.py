import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import mixing
from tests.llm.conftest import SCHEMA, odd_rows, prose


def brute_targets(sizes, weights, total_share=1.5, most=2.0):
    """Share, stop at the bound, share the excess by weight again."""
    total = total_share * sum(sizes)
    full = set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        share = [rest * w / weight if weight else 0 for w in weights]
        above = {i for i, s in enumerate(sizes) if i not in full and share[i] > most * s}
        if not above:
            return [most * s if i in full else share[i] for i, s in enumerate(sizes)]
        full |= above


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1, 1000], [500, 3, 3, 3], [7], [0, 4, 9, 0], [5, 2, 1]])
def test_targets_equal_brute_force(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    sources = spark.createDataFrame(rows, "source string, source_size long")
    found = mixing.targets(sources.withColumn("weight", mixing.cyclic_weights()))
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = [row.target for row in found.orderBy("source").collect()]
    assert got == pytest.approx(brute_targets(sizes, weights), rel=1e-9)


def test_newton_finds_the_rates(spark):
    rows = [("a", 100, 150.0), ("b", 1000, 3.0), ("c", 10, 20.0), ("d", 0, 0.0)]
    sources = spark.createDataFrame(rows, "source string, source_size long, target double")
    found = {row.source: row.rate for row in mixing.multipliers(sources).collect()}
    assert found["a"] == pytest.approx(1.5) and found["b"] == pytest.approx(0.003)
    assert found["c"] == pytest.approx(2.0) and found["d"] == 0


def test_multipliers_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 2)
    sources = spark.createDataFrame([("a", 1000, 3.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError, match="after 2 steps"):
        mixing.multipliers(sources)


def test_copies_follow_the_rate():
    sizes = np.sort(np.random.default_rng(1).integers(0, 500, 300))[::-1]
    for rate in (0.0, 0.3, 1.0, 1.37, 2.0):
        copies = mixing.copies_of(sizes, rate)
        assert set(copies) <= {int(np.floor(rate)), int(np.ceil(rate))}
        assert abs((copies * sizes).sum() - rate * sizes.sum()) <= 2


def test_copies_of_equal_documents_are_those_of_each():
    chance = np.random.default_rng(2)
    for rate in (0.0, 0.25, 0.5, 1.0, 1.375, 2.0, 0.2, 1.31):
        for _ in range(40):
            sizes = np.sort(chance.integers(0, 60, 12))[::-1]
            counts = chance.integers(1, 9, 12)
            each = mixing.copies_of(np.repeat(sizes, counts), rate)
            ends = np.cumsum(counts)
            want = np.array([each[a:b].sum() for a, b in zip(ends - counts, ends)])
            found = mixing.copies_of_equal(sizes, counts, rate)
            if rate * 8 == int(rate * 8):
                assert found.tolist() == want.tolist()
            # Sums of other fractions are rounded, and may fall to either side of a half.
            assert ((found >= counts * int(rate)) & (found <= counts * math.ceil(rate))).all()
            assert abs(((found - rate * counts) * sizes).sum()) <= abs(((want - rate * counts) * sizes).sum()) + 60


def test_resampling_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rows = [(1, prose(1, 9), "en", "a", 1)] * 100 + [(i, prose(i, 5 + i % 9), "en", "ab"[i % 2], 1) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = mixing.mixed(docs).groupBy("row.doc_id").agg(F.sum("copies").alias("n")).filter("n > 0")
    got = mixing.resampled(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sources_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 50)
    rows = [(i, prose(i, 5 + i % 90), "en", "xyz"[i % 7 % 3], 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mixed(docs, carry=["doc_id", "source"])
    again = mixing.mixed(docs.repartition(7), carry=["doc_id", "source"])
    key = [F.col("row.doc_id"), F.col("copies")]
    assert sorted(found.select(*key).collect()) == sorted(again.select(*key).collect())
    taken = found.groupBy("row.source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"),
        F.first("target").alias("target"),
        F.max("copies").alias("most"),
    )
    for row in taken.collect():
        assert row.most <= 2 and row.taken == pytest.approx(row.target, rel=0.01)
    copies = {row["row"].doc_id: row.copies for row in found.collect()}
    sampled = mixing.resampled(docs)
    assert sampled.columns == docs.columns
    counts = {row.doc_id: row["count"] for row in sampled.groupBy("doc_id").count().collect()}
    assert counts == {key: n for key, n in copies.items() if n}


def test_odd_documents(odd, nothing):
    found = mixing.mixed(odd, carry=["doc_id"]).collect()
    assert len(found) == len(odd_rows())
    assert all(row.copies <= 2 for row in found)
    assert mixing.resampled(odd).columns == odd.columns
    assert mixing.mixed(nothing).count() == 0
