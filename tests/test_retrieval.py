import numpy as np
import pytest

from plan import plan_of
from tallymill.functions.vectors import has_length
from tallymill.operators import nearest, retrieval
from tallymill.operators.inverted import fit_lists
from tallymill.operators.retrieval import context, contexts_for, embed, top_k
from pyspark.sql import functions as F

INDEX = "id long, embedding array<float>"
QUERY = "query_id long, embedding array<float>"


def brute_force(queries, index, k):
    """Ranks by cosine, ties by id, vectors without length last."""
    result = {}
    for query_id, wanted in queries:
        q = np.asarray(wanted, dtype=np.float32).astype(float)
        scored = []
        for doc_id, vector in index:
            d = np.asarray(vector, dtype=np.float32).astype(float)
            usable = all(np.isfinite(x).all() and np.abs(x).max() > 0 for x in (q, d))
            similarity = None
            if usable:
                q1, d1 = q / np.abs(q).max(), d / np.abs(d).max()
                similarity = round(float(q1 @ d1 / np.linalg.norm(q1) / np.linalg.norm(d1)), 12)
            scored.append((similarity is None, -(similarity or 0.0), doc_id))
        result[query_id] = [doc_id for _, _, doc_id in sorted(scored)[:k]]
    return result


def found(df):
    rows = sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    result = {}
    for query_id, rank, doc_id in rows:
        result.setdefault(query_id, []).append(doc_id)
        assert rank == len(result[query_id])
    return result


def make(seed, n, m, dims=8, clusters=5, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dims)) * 3
    vectors = centers[rng.integers(clusters, size=n)] + rng.normal(size=(n, dims))
    vectors[:copies] = vectors[0]
    index = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    wanted = centers[rng.integers(clusters, size=m)] + rng.normal(size=(m, dims))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(wanted)], index


@pytest.mark.parametrize("block", [60, 10**6])
@pytest.mark.parametrize("seed, n, m, k, copies", [(1, 400, 30, 3, 0), (2, 300, 20, 5, 150)])
def test_top_k_equals_brute_force(spark, block, seed, n, m, k, copies):
    queries, index = make(seed, n, m, copies=copies)
    if copies:
        queries.append((m, index[0][1]))
    result = top_k(
        spark.createDataFrame(queries, QUERY),
        spark.createDataFrame(index, INDEX).repartition(3),
        k,
        block_values=block,
    )
    assert found(result) == brute_force(queries, index, k)


NAN, TINY, INF = float("nan"), 1e-45, float("inf")


@pytest.mark.parametrize("block", [2, 100])
def test_vectors_without_direction_rank_last(spark, block):
    odd = [[0.0, 0.0], [NAN, 1.0], [INF, 1.0], [None, 1.0], [], None]
    queries = [(1, [1.0, 0.0]), (2, [TINY, 0.0]), (3, [0.5, 0.5]), *[(10 + i, v) for i, v in enumerate(odd)]]
    index = [(5, [0.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, TINY]), (4, [NAN, 0.0]), (3, [None, 2.0]), (9, None)]
    result = top_k(
        spark.createDataFrame(queries, QUERY),
        spark.createDataFrame(index, INDEX),
        3,
        block_values=block,
    )
    want = {1: [6, 7, 3], 2: [6, 7, 3], 3: [6, 7, 3]} | {10 + i: [3, 4, 5] for i in range(len(odd))}
    assert found(result) == want


def test_many_queries_with_odd_vectors_equal_brute_force(spark):
    queries, index = make(4, 200, 60)
    for at in range(0, 60, 7):
        queries[at][1][0] = [0.0, NAN, INF][at % 3]
    for at in range(0, 200, 9):
        index[at] = (at, [[0.0] * 8, [NAN] * 8, [TINY] * 8][at % 3])
    result = top_k(
        spark.createDataFrame(queries, QUERY), spark.createDataFrame(index, INDEX), 4, block_values=100
    )
    assert found(result) == brute_force(queries, index, 4)


def test_empty_sides(spark):
    some = [(1, [1.0, 0.0])]
    no_index = spark.createDataFrame([], INDEX)
    no_queries = spark.createDataFrame([], QUERY)
    queries, index = spark.createDataFrame(some, QUERY), spark.createDataFrame(some, INDEX)
    assert top_k(queries, no_index).isEmpty()
    assert top_k(no_queries, index).isEmpty()


def test_text_ids(spark):
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<float>")
    index = spark.createDataFrame(
        [("b", [1.0, 1.0]), ("a", [2.0, 2.0]), ("c", [1.0, 0.0])],
        "id string, embedding array<float>",
    )
    assert found(top_k(queries, index, 2)) == {"q": ["a", "b"]}


def test_plan_limits_before_the_shuffle(spark):
    queries, index = make(3, 50, 5)
    plan = plan_of(top_k(spark.createDataFrame(queries, QUERY), spark.createDataFrame(index, INDEX)))
    assert "WindowGroupLimit" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_has_length(spark):
    rows = [([3.0, 4.0], True), ([0.0], False), ([], False), (None, False), ([1.0, None], False), ([NAN], False)]
    df = spark.createDataFrame(rows, "v array<float>, want boolean")
    assert all(a == b for a, b in df.select(has_length(F.col("v")), "want").collect())


def test_question_text_to_context(spark):
    def count_letters():
        return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts])

    docs = spark.createDataFrame(
        [("x", "x.md", "aaab"), ("y", "y.md", "abbb"), ("z", "z.md", "")], "id string, source string, text string"
    )
    index = embed(docs, count_letters)
    questions = spark.createDataFrame([(1, "bb"), (2, "aa"), (3, None)], "query_id long, text string")
    got = {r.query_id: r.context for r in contexts_for(questions, index, count_letters, 1).collect()}
    assert got == {1: "- y.md: abbb", 2: "- x.md: aaab", 3: "- x.md: aaab"}


def test_context_joins_chunks_best_first(spark):
    index = spark.createDataFrame(
        [("a", "a.md", "x" * 700), ("b", "b.md", "short")], "id string, source string, text string"
    )
    ranked = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id long, id string, rank int")
    (row,) = context(ranked, index).collect()
    assert row.context == "- b.md: short\n\n- a.md: " + "x" * 600


def test_queries_stay_out_of_the_driver(spark, monkeypatch):
    """One scan of the index however many blocks, and no table of queries on the driver."""

    def refused(self):
        raise AssertionError("a table reached the driver")

    queries, index = make(3, 200, 40)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", refused)
    monkeypatch.setattr(retrieval, "GROUP_VALUES", 100)
    result = top_k(
        spark.createDataFrame(queries, QUERY), spark.createDataFrame(index, INDEX), 3, block_values=20
    )
    assert plan_of(result).count("MapInPandas") <= 1
    assert found(result) == brute_force(queries, index, 3)


def test_vectors_of_several_dimensions_stop_the_search_early(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 0.0])], QUERY)
    index = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0, 2.0]), (9, [])], INDEX)
    for search in (lambda: top_k(queries, index), lambda: fit_lists(index)):
        with pytest.raises(ValueError, match="such as 8"):
            search()
    # Vectors without a direction may have any length.
    assert found(top_k(queries, index.filter("id != 8"), 2)) == {1: [7, 9], 2: [7, 9]}


def test_a_small_file_of_vectors_is_searched_by_several_tasks(spark):
    index = spark.range(5000).coalesce(1)
    assert retrieval.dealt(index, 10).rdd.getNumPartitions() == min(5, spark.sparkContext.defaultParallelism)
    assert retrieval.dealt(index, 10**12).rdd.getNumPartitions() == 5
    assert retrieval.dealt(index.limit(0), 10).rdd.getNumPartitions() == 1


def test_best_rows_over_tiles_and_parts_of_the_queries(monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 7)
    chance = np.random.default_rng(5)
    units, wanted = (chance.integers(-2, 3, (n, 3)).astype(float) + 0.1 for n in (60, 9))
    ids = np.array([f"id-{n % 50}" for n in chance.permutation(60)])
    best = nearest.Best(wanted, units, nearest.id_ranks(ids), 4)
    best.look(0, 20, np.arange(0, 9, 2))
    best.look(0, 20, np.arange(1, 9, 2))
    best.look(20, 60)
    found = best.found(np.arange(9), ids)
    similarity = np.round(wanted @ units.T, nearest.DIGITS) + 0.0
    for query in range(9):
        want = sorted(zip(-similarity[query], ids))[:4]
        mine = found[found["query_id"] == query]
        assert sorted(zip(-mine["similarity"], mine["id"])) == want
