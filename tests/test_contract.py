import duckdb
import pytest

import __spark_entry__ as contract
import check_oracle
from workload.oracle import oracle
from workload.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    base = duckdb.connect()
    for name in check_oracle.TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return base


def test_every_query_has_sql():
    assert set(all_queries()) == set(oracle())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["question_id", "query", "answer"]
    assert result.count() == 200


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_agrees_with_sql(spark, tables, name):
    result = contract.queries()[name](spark, FOLDER)
    assert all(kind != "array" for _, kind in result.dtypes)
    got = check_oracle.normal(result.toPandas())
    want = check_oracle.normal(tables.execute(contract.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
