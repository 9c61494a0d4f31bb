import random

import numpy as np
from pyspark.sql import functions as F

from tallymill.llm import pairwise_quality
from tests.llm.conftest import SCHEMA, odd_rows, prose

LABELS = "doc_id long, quality int"


def documents(n):
    chance = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 30 + i % 40).split()
        bad = i % 4 == 0
        if bad:
            words = [w + chance.choice(["$$$", "###", ""]) for w in words]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not bad)))
    return rows, labels


def test_newton_meets_the_condition_of_the_optimum():
    differences = np.random.default_rng(1).normal(0.3, 1, (500, 4))
    weights = pairwise_quality.newton(differences)
    lose = 1 / (1 + np.exp(differences @ weights))
    gradient = weights / 100 - differences.T @ lose / len(differences)
    assert np.abs(gradient).max() < 1e-8


def test_held_out_documents_are_ranked(spark):
    rows, labels = documents(400)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    ranker = pairwise_quality.learn(docs, known, F.col("doc_id") % 5 != 0)
    found = pairwise_quality.scored(docs, ranker, carry=["doc_id"]).collect()
    truth = dict(labels)
    held = [row for row in found if row["row"].doc_id % 5 == 0]
    right = sum(row.predicted == truth[row["row"].doc_id] for row in held)
    assert right / len(held) > 0.95
    assert all((row.score >= 0.3) == (row.predicted == 1) and 0 <= row.score <= 1 for row in found)


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    rows, labels = documents(300)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    first = pairwise_quality.learn(docs, known, F.lit(True), most=100)
    again = pairwise_quality.learn(docs.repartition(5), known.repartition(3), F.lit(True), most=100)
    assert np.allclose(first.weights, again.weights)


def test_odd_documents(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (4, None), (99, 1), (7, 1), (6, 0)], LABELS
    )
    ranker = pairwise_quality.learn(odd, labels, F.lit(True))
    found = pairwise_quality.scored(odd, ranker).collect()
    assert len(found) == len(odd_rows())
    assert all(0 <= row.score <= 1 for row in found)
    blank = pairwise_quality.learn(odd, labels.limit(0), F.lit(True))
    same = pairwise_quality.scored(odd, blank).collect()
    assert {round(row.score, 9) for row in same} == {0.3}
    assert pairwise_quality.scored(nothing, blank).count() == 0


def test_every_label_counts_however_many(spark):
    rows, labels = documents(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, LABELS)
    ranker = pairwise_quality.learn(docs, known, F.lit(True), most=50)
    vectors = np.array([pairwise_quality.features(row[1].encode()) for row in rows])
    assert np.allclose(ranker.mean, vectors.mean(axis=0))
    spread = vectors.std(axis=0)
    assert np.allclose(ranker.spread, np.where(spread > 1e-9, spread, 1))
    share = sum(label == 0 for _, label in labels) / len(labels)
    assert np.isclose(ranker.limit, np.quantile(ranker.plain_scores(vectors), share))
    good, bad = pairwise_quality.pairs_of(700, 30)
    assert len(good) == len(bad) and set(good) == set(range(700)) and set(bad) == set(range(30))


def test_a_rare_kind_is_in_every_block(spark):
    rows = [(i, int(i != 77), [float(i)]) for i in range(400)]
    known = spark.createDataFrame(rows, "key long, label int, vector array<double>")
    dealt = pairwise_quality._in_blocks(known, {1: 399, 0: 1}, most=40).toPandas()
    assert set(dealt["key"]) == set(range(400))
    assert sorted(dealt[dealt["label"] == 0]["block"]) == list(range(10))
    assert not dealt.duplicated(["key", "block"]).any()


def test_the_quantile_is_exact(spark):
    chance = np.random.default_rng(3)
    for values in (chance.normal(0, 1, 500), np.repeat([1.0, 2.0, 1e9], 40), np.array([0.5, 0.7])):
        scores = spark.createDataFrame([(float(x),) for x in values], "score double")
        for share in (0.0, 0.3, 1 / 3, 0.77, 1.0):
            found = pairwise_quality.quantile(scores, share, len(values), most=20)
            assert np.isclose(found, np.quantile(values, share))
