import numpy as np
import pytest

from test_retrieval import INDEX, QUERY, brute_force, found, make
from tallymill.operators import inverted
from tallymill.operators.inverted import fit_lists, probes_for, recall_of, search
from tallymill.operators.retrieval import top_k


def tables(spark, queries, index):
    return spark.createDataFrame(queries, QUERY), spark.createDataFrame(index, INDEX).repartition(3)


@pytest.mark.parametrize("probes", [1, 3, 99])
@pytest.mark.parametrize("seed, copies, group", [(1, 0, 10**7), (2, 150, 100)])
def test_bounds_make_the_search_exact(spark, monkeypatch, probes, seed, copies, group):
    monkeypatch.setattr(inverted, "GROUP_VALUES", group)
    queries, index = make(seed, 400, 30, copies=copies)
    queries += [(30, index[0][1]), (31, [0.0] * 8), (32, [float("nan")] + [1.0] * 7)]
    index += [(1000, [0.0] * 8), (1001, [float("inf")] * 8)]
    asked, rows = tables(spark, queries, index)
    lists = fit_lists(rows, 12)
    assert len(lists.centroids) == 12 and lists.rows.count() == 400
    assert found(search(asked, lists, 3, probes, exact=True)) == brute_force(queries, index, 3)


def test_recall_is_what_was_asked_for(spark):
    queries, index = make(3, 2000, 120, clusters=25)
    asked, rows = tables(spark, queries, index)
    lists, exact = fit_lists(rows), top_k(asked, rows, 3)
    probes = probes_for(asked, lists, recall=0.95)
    assert 1 <= probes < len(lists.centroids) / 2
    assert recall_of(search(asked, lists, 3, probes), exact) >= 0.95
    assert recall_of(search(asked, lists, 3, len(lists.centroids)), exact) == 1.0
    assert recall_of(search(asked, lists, 3, 1), exact) < 1.0


def test_bounds_rule_out_rows(spark, monkeypatch):
    """Far fewer pairs than queries times rows are compared."""
    queries, index = make(4, 3000, 40, clusters=40, dims=4)
    asked, rows = tables(spark, queries, index)
    lists = fit_lists(rows)
    wanted = inverted.materialize(asked, "queries")
    stored = wanted.selectExpr("*", "0.05D AS reach")
    seen = inverted._scan(inverted.materialize(stored, "queries"), lists, 3000, 1, True).count()
    assert seen < 0.2 * 40 * 3000


def test_small_and_empty_tables(spark):
    asked, rows = tables(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0])])
    assert found(search(asked, fit_lists(rows), 3, exact=True)) == {1: [1]}
    lists = fit_lists(rows.limit(0))
    assert search(asked, lists).count() == 0 and probes_for(asked, lists) == 1
    flat = fit_lists(spark.createDataFrame([(5, [0.0, 0.0])], INDEX))
    assert found(search(asked, flat)) == {1: [5]}
    assert search(asked.limit(0), fit_lists(rows), exact=True).count() == 0
    assert recall_of(asked.selectExpr("query_id", "1 AS id").limit(0), asked.selectExpr("query_id", "1 AS id").limit(0)) == 1.0


def test_equal_vectors_are_one_centroid(spark):
    index = [(i, [1.0, 2.0]) for i in range(50)] + [(50, [2.0, 1.0])]
    asked, rows = tables(spark, [(0, [1.0, 2.0])], index)
    lists = fit_lists(rows, 10)
    assert len(lists.centroids) == 2 and np.isfinite(lists.radii).all()
    assert found(search(asked, lists, 3, 1, exact=True)) == {0: [0, 1, 2]}


def test_a_block_of_queries_never_exceeds_a_tile():
    for lists, dimensions in ((89, 64), (4096, 64), (1, 1), (0, 0)):
        assert 1 <= inverted.queries_at_once(lists, dimensions) <= inverted.TILE
