import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from plan import plan_of
from tallymill.operators import skew
from tallymill.operators.matching import SET, Matches
from workload import queries

LARGEST = Decimal("9999999999999999.99")
GROUPS = {
    "largest": [LARGEST] * 40,
    "least": [-LARGEST] * 40,
    "both": [LARGEST, -LARGEST, Decimal("-0.01"), Decimal("0.01"), None],
    "cents": [Decimal(n) / 100 for n in range(-250, 300, 7)],
    "halves": [Decimal(n) / 100 for n in (2**30, 2**30 - 1, -(2**30), -(2**30) - 1, -1, 0)],
    "null": [None, None],
}


def test_halves_of_amounts_have_the_sum_of_the_amounts(spark):
    rows = [(name, amount) for name, amounts in GROUPS.items() for amount in amounts]
    df = queries._with_halves(spark.createDataFrame(rows, "name string, amount decimal(18,2)"))
    summed = df.groupBy("name").agg(
        F.sum("amount").alias("plain"), queries._sum_of_halves().alias("halves")
    )
    assert summed.schema["halves"].dataType == summed.schema["plain"].dataType
    found = {row.name: row for row in summed.collect()}
    assert set(found) == set(GROUPS)
    for name, amounts in GROUPS.items():
        known = [amount for amount in amounts if amount is not None]
        assert found[name].halves == found[name].plain == (sum(known) if known else None)


def test_listed_rows_are_summed_as_whole_numbers(spark, tmp_path):
    words = ["small widget", "promo rod", "red bolt"]
    parts = [(key, "PROMO TIN", words[key % 3], "Brand#1") for key in range(18)]
    items = [
        (n, 1, n % 18, dt.date(1998, 8, 2) - dt.timedelta(n * n % 800), n * 1.01 - 50, "RN"[n % 2])
        for n in range(120)
    ]
    items.append((120, 1, 1, dt.date(1998, 8, 2), None, "N"))
    spark.createDataFrame(
        parts, "p_partkey long, p_type string, p_name string, p_brand string"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        items,
        "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate date, "
        "l_extendedprice double, l_returnflag string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries.recent_of_some(spark, str(tmp_path))
    rows = queries._matches(spark, str(tmp_path), F.lit("widget or promo")).of_questions()
    plain = rows.groupBy("question_id", "used_fallback").agg(*queries._row_measures())
    want = queries._flat(plain)
    assert found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert found.count() == 18
    plan = plan_of(found)
    assert "partial_sum(high" in plan and "partial_sum(amount" not in plan
    assert "partial_sum(amount" in plan_of(want)


def test_rows_are_copied_little_where_the_listing_is_large(spark, monkeypatch):
    """Sizes may be too large: those of a large table make the cuts, few rows are listed."""
    stored = {}

    def kept(df, name, materialize=skew.materialize):
        stored[name] = materialize(df, name)
        return stored[name]

    monkeypatch.setattr(skew, "materialize", kept)
    of_set = [F.lit("").alias("hits"), F.lit("all").alias("window")]
    ids = F.col("id").alias("question_id")
    members = spark.range(2000).select(ids, F.lit(False).alias("used_fallback"), *of_set)
    rows = spark.range(30).select(*of_set, F.col("id").alias("amount"))
    sizes = spark.createDataFrame([("", "all", 10**7)], "hits string, window string, rows long")
    listed = Matches(members, rows, sizes).of_questions()
    (cut,) = stored["cuts"].select(*SET, "left_cuts", "right_cuts").collect()
    assert max(cut.left_cuts, cut.right_cuts) < 100
    found = listed.groupBy("question_id").agg(F.sum("amount").alias("amount")).collect()
    assert [row.amount for row in found] == [sum(range(30))] * 2000
