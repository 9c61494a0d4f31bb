import pytest
from pyspark.sql import functions as F

from tallymill.functions.keywords import KNOWN_MERCHANTS, STOP_WORDS, matches
from tallymill.operators.questions import clean_questions, parse_questions

LISTED = [
    ("Spending by category for last month", "last month", ["category"]),
    ("Spending on subscriptions last month", "last month", ["subscriptions"]),
    ("Spending on groceries this month", "this month", ["groceries"]),
    ("Top merchant for the last year", "last year", ["merchant"]),
    ("Spending at Starbucks this month", "this month", ["starbucks"]),
    ("Total spending last week", "last week", ["total"]),
    ("Compare spending this month vs last month", "last month", []),
    ("Show income this month", "this month", ["income"]),
    ("Highest category spend this year", "this year", ["category", "highest"]),
    ("Recent transactions for a merchant", "all", ["merchant", "recent"]),
]


def parse(spark, queries, **options):
    df = spark.createDataFrame(list(enumerate(queries)), "question_id long, query string")
    return parse_questions(df, **options).orderBy("question_id").collect()


def test_listed_questions(spark):
    rows = parse(spark, [query for query, _, _ in LISTED])
    assert [(r.window, r.keywords) for r in rows] == [(w, k) for _, w, k in LISTED]


def test_fixed_word_lists():
    assert len(set(STOP_WORDS)) == 36
    assert len(set(KNOWN_MERCHANTS)) == 18


@pytest.mark.parametrize(
    "query, keywords, merchant_keywords",
    [
        ("Trader Joe's and groceries", ["groceries", "joe", "trader"], ["trader", "joe"]),
        ("zebra Zebra ZEBRA", ["zebra"], ["zebra"]),
        ("café 12abc34 x_yz", ["abc", "caf"], ["abc", "caf"]),
        ("is it me", [], []),
        ("", [], []),
    ],
)
def test_keywords(spark, query, keywords, merchant_keywords):
    (row,) = parse(spark, [query])
    assert row.keywords == keywords
    assert sorted(row.merchant_keywords) == sorted(merchant_keywords)
    assert row.needle == " ".join(keywords)


def test_known_merchants_are_a_parameter(spark):
    (row,) = parse(spark, ["small bolt"], known=("bolt",))
    assert (row.keywords, row.merchant_keywords) == (["bolt", "small"], ["bolt"])
    (row,) = parse(spark, ["small bolt"], known=())
    assert row.merchant_keywords == ["bolt", "small"]


def test_keywords_match_literally(spark):
    df = spark.createDataFrame([("Netflix",), ("n.t",), (None,)], "v string")
    found = df.select(matches(F.col("v"), F.array(F.lit("net")))).collect()
    assert [value for (value,) in found] == [True, False, False]


def test_blank_questions_are_dropped(spark):
    rows = [(1, "  hello\t\n"), (2, " \n "), (3, "")]
    df = spark.createDataFrame(rows, "question_id long, query string")
    assert [tuple(r) for r in clean_questions(df).collect()] == [(1, "hello")]
