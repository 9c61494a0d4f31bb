import re

import pytest

import check_oracle
import corpus_pipeline
from tallymill.llm.common import table
from tallymill.llm.queries import llm_oracle, llm_queries
from tallymill.session import materialize
from tests.llm.conftest import CLASH, SCHEMA, prose, rows_of
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard_join import brute as brute_links
from tests.llm.test_quality_rules import brute as brute_measures

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, FOLDER, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), f"test-{name}")
        found.append(docs)
    return found


def texts_of(df):
    return {row.doc_id: row.text for row in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_what_passes_the_rules(stages):
    before, after = texts_of(stages[0]), texts_of(stages[1])
    for key, text in before.items():
        words, _, _, _, repeated, _ = brute_measures(text)
        assert (key in after) == (words >= 20 and 100 * repeated <= 30 * words)


def test_one_of_each_group_stays(stages):
    rows = sorted(texts_of(stages[1]).items())
    want = {least for _, least, _, _ in brute_links(rows)}
    assert set(texts_of(stages[2])) == want


def test_benchmark_passages_are_gone(spark, stages):
    items = [tuple(row) for row in table(spark, FOLDER, "benchmark").collect()]
    before, after = texts_of(stages[2]), texts_of(stages[3])
    for key, text in before.items():
        words, hit, _ = brute_hits(text, items)
        assert (key in after) == (2 * hit <= words)
        if key in after:
            assert (after[key] == text) == (hit == 0)
            assert len(re.findall(r"\w+", after[key])) <= len(re.findall(r"\w+", text))
    for row in stages[3].collect():
        assert row.n_chars == len(row.text)


def test_mix_repeats_documents_at_most_twice(stages):
    counts = {}
    for row in stages[4].collect():
        counts[row.doc_id] = counts.get(row.doc_id, 0) + 1
    assert max(counts.values()) == 2
    assert set(counts) <= set(texts_of(stages[3]))


def test_tokens_follow_the_mix(stages):
    assert sorted(r.doc_id for r in stages[5].collect()) == sorted(r.doc_id for r in stages[4].collect())
    at = 0
    for row in stages[5].orderBy("start").collect():
        assert row.start == at
        at += row.n_tokens


def test_few_documents_go_to_the_tokenizer_at_a_time(spark, stages):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        corpus_pipeline.tokens(spark, stages[-2], FOLDER)
        assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, before)


def test_run_gives_the_last_stage(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, FOLDER), "*") == rows_of(stages[5], "*")


def test_empty_documents_pass_through(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "test-empty")
    assert docs.count() == 0


def test_odd_documents_pass_through_all_stages(spark, odd):
    """Nulls, blank and very long texts, repeated rows, near copies and clashing names."""
    (passage,) = table(spark, FOLDER, "benchmark").select("text").limit(1).collect()
    more = [(100 + i, prose(100 + i, 40 + i), "en", "ab"[i % 2], 1) for i in range(30)]
    more += [(200, f"{prose(200, 60)} {passage.text} {prose(201, 60)}", "en", "a", 1), (201, f"{passage.text} {prose(202, 10)}", "en", "b", 1)]
    extra = spark.createDataFrame(more, SCHEMA)
    for name in CLASH:
        extra = extra.selectExpr("*", f"'extra' AS {name}")
    docs, kept = odd.unionByName(extra), []
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.dtypes
        docs = materialize(stage(spark, docs, FOLDER), "test-odd")
        kept.append(docs)
    assert all(df.dtypes == columns for df in kept[:-1])
    good, single, clean, mixed, tokens = ([row.doc_id for row in df.collect()] for df in kept)
    others = list(range(100, 130))
    assert sorted(good, key=str) == sorted([1, 1, 2, 7, 8, None, 200, 201, *others], key=str)
    assert sorted(single, key=str) == sorted([1, 7, None, 200, 201, *others], key=str)
    assert sorted(clean, key=str) == sorted([1, 7, None, 200, *others], key=str)
    texts = {row.doc_id: row for row in kept[2].collect()}
    assert passage.text not in texts[200].text and texts[200].n_chars == len(texts[200].text)
    assert texts[1].row == texts[1].score == "extra"
    assert set(mixed) <= set(clean) and all(mixed.count(key) <= 2 for key in clean)
    assert sorted(tokens, key=str) == sorted(mixed, key=str)


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_registered_queries(spark, name):
    import duckdb

    result = llm_queries()[name](spark, FOLDER)
    got = result.toPandas()
    if "doc_id" in got:
        assert sorted(got["doc_id"]) == list(range(200))
    assert "doc_id" in got or name in llm_oracle()
    if name in llm_oracle():
        base = duckdb.connect()
        for other in ("documents", "benchmark", "conversations", "embeddings"):
            base.execute(f"CREATE VIEW {other} AS SELECT * FROM '{FOLDER}/{other}.parquet'")
        want = check_oracle.normal(base.execute(llm_oracle()[name]).df())
        assert check_oracle.normal(got).equals(want)
