import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import brute
from plan import plan_of
from tallymill.functions.keywords import KNOWN_MERCHANTS
from tallymill.operators import skew
from tallymill.operators.matching import matching_transactions, newest_first, transactions_for
from tallymill.operators.summary import category_breakdown, top_merchants, totals
from tallymill.plans.answers import AnswerBook

SCHEMA = "date date, amount decimal(18,2), category string, merchant string, note string"
CATEGORIES = ["Groceries", "Dining", "Subscriptions", "Income", "income", "", None, "Travel"]
MERCHANTS = [
    "Netflix", "Starbucks", "Whole Foods", "Trader Joe's", "City Water", "Payroll", "", None,
    "International Networking", "Café Noir", "banana-ana", "STARBUCKS RESERVE",
]
QUESTIONS = [
    "how much did I spend on subscriptions last month",
    "show me spending at Starbucks this month",
    "Starbucks and dining last year",
    "whats my net worth",
    "SUBSRIPTIONS",
    "internationally this year",
    "International today",
    "compare spending this month vs last month",
    "show income this week",
    "joe's groceries yesterday",
    "ana",
    "spending",
    "what did I spend on groceries",
    "trav or din last week",
    "networks",
    "networking",
    "show income this week",
]


def make_rows(seed: int, n: int = 300) -> list[dict]:
    rng = random.Random(seed)
    newest = dt.date(2024, 3, 31)
    rows = []
    for number in range(n):
        age = rng.choice([0, 0, 1, 3, 7, 20, 31, 90, 366, 700])
        rows.append(
            {
                "date": None if rng.random() < 0.05 else newest - dt.timedelta(age),
                "amount": None if rng.random() < 0.05 else Decimal(rng.randrange(1, 99999)) / 100,
                "category": rng.choice(CATEGORIES),
                "merchant": rng.choice(MERCHANTS),
                "note": f"row {number}",
            }
        )
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(row.values()) for row in rows], SCHEMA)


def asked(spark, questions=QUESTIONS):
    return spark.createDataFrame(list(enumerate(questions)), "question_id long, query string")


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    rows = make_rows(request.param)
    known = KNOWN_MERCHANTS if request.param == 1 else ("net",)
    return rows, frame(spark, rows), known


def test_rows_of_many_questions(spark, case):
    rows, txns, known = case
    found = matching_transactions(asked(spark), txns, known).of_questions().collect()
    for number, query in enumerate(QUESTIONS):
        expected, fallback = brute.matching(query, rows, set(known))
        mine = [r for r in found if r.question_id == number]
        assert sorted(r.note for r in mine) == sorted(r["note"] for r in expected), query
        assert {r.used_fallback for r in mine} <= {fallback}, query


def test_rows_when_every_key_is_crowded(spark, case, monkeypatch):
    rows, txns, known = case
    monkeypatch.setattr(skew, "ROWS_PER_SIDE", 3)
    found = matching_transactions(asked(spark), txns.repartition(4), known).of_questions().collect()
    for number, query in enumerate(QUESTIONS):
        expected, _ = brute.matching(query, rows, set(known))
        mine = [r.note for r in found if r.question_id == number]
        assert sorted(mine) == sorted(r["note"] for r in expected), query


def test_words_and_values_that_share_their_first_letters(spark, monkeypatch):
    """One gram, and one word, meets very many on both sides."""
    monkeypatch.setattr(skew, "ROWS_PER_SIDE", 4)
    ends = [a + b for a in "abcdefg" for b in "hijklmn"]
    names = [f"Network{end}" for end in ends] + [f"Network{end} Networks" for end in ends]
    rows = [
        {"date": dt.date(2024, 3, 1), "amount": Decimal(n), "category": "c", "merchant": name, "note": f"row {n}"}
        for n, name in enumerate(names)
    ]
    questions = [f"network{end} or networks this year" for end in ends] + [f"network{end}" for end in ends]
    book = AnswerBook.open(asked(spark, questions), frame(spark, rows), ())
    found = {r.question_id: (r.total_spend, r.transaction_count) for r in book.summaries().collect()}
    for number, query in enumerate(questions):
        want = brute.summary(brute.matching(query, rows, set())[0])
        assert found[number] == (want["total_spend"], want["transaction_count"]), query


def test_rows_of_one_question(spark, case):
    rows, txns, known = case
    for query in QUESTIONS[:8]:
        expected, fallback = brute.matching(query, rows, set(known))
        found = transactions_for(query, txns, known).collect()
        assert sorted(r.note for r in found) == sorted(r["note"] for r in expected), query
        assert {r.used_fallback for r in found} <= {fallback}, query


def test_summaries_breakdowns_and_top_merchants(spark, case):
    rows, txns, known = case
    book = AnswerBook.open(asked(spark), txns, known)
    summaries = {r.question_id: r for r in book.summaries().collect()}
    categories = book.category_breakdown().orderBy("question_id", "rank").collect()
    merchants = book.top_merchants().orderBy("question_id", "rank").collect()
    answers = {r.question_id: r.answer for r in book.answers().collect()}
    assert len(summaries) == len(QUESTIONS)
    for number, query in enumerate(QUESTIONS):
        matched, fallback = brute.matching(query, rows, set(known))
        expected = brute.summary(matched)
        mine = summaries[number]
        assert mine.used_fallback == fallback, query
        for name in ("total_spend", "total_income", "net", "transaction_count"):
            assert mine[name] == expected[name], (query, name)
        got = [(r.category, r.spend) for r in categories if r.question_id == number]
        assert got == expected["categories"], query
        got = [(r.merchant, r.spend) for r in merchants if r.question_id == number]
        assert got == expected["merchants"], query
        assert answers[number] == (
            f"You spent ${expected['total_spend']:.2f} across "
            f"{expected['transaction_count']} transactions."
        )


def test_summaries_of_rows_equal_summaries_of_cells(spark, case):
    _, txns, known = case
    by = ["question_id"]
    matched = matching_transactions(asked(spark), txns, known).of_questions()
    book = AnswerBook.open(asked(spark), txns, known)

    def rows_of(df, *columns):
        return sorted(tuple(r) for r in df.select(*by, *columns).collect())

    sums = ["total_spend", "total_income", "net", "transaction_count"]
    assert rows_of(totals(matched, by), *sums) == rows_of(book.summaries(), *sums)
    for build, own in (
        (category_breakdown(matched, by), book.category_breakdown()),
        (top_merchants(matched, by), book.top_merchants()),
    ):
        assert rows_of(build, *build.columns) == rows_of(own, *build.columns)


def test_a_question_without_rows_is_answered_with_zeros(spark):
    txns = frame(spark, [])
    book = AnswerBook.open(asked(spark, ["groceries today", "spending"]), txns)
    for row in book.summaries().collect():
        assert (row.total_spend, row.total_income, row.net, row.transaction_count) == (0, 0, 0, 0)
    assert {r.answer for r in book.answers().collect()} == {
        "You spent $0.00 across 0 transactions."
    }
    assert book.top_merchants().isEmpty()


def test_only_asked_windows_are_read(spark, tmp_path):
    path = str(tmp_path / "txns")
    frame(spark, make_rows(6)).write.parquet(path)
    stored = spark.read.parquet(path)
    recent = asked(spark, ["groceries this month", "dining this week", "zzz this month"])
    book = AnswerBook.open(recent, stored)
    assert {r.window for r in book.cells.select("window").collect()} == {"this month", "this week"}
    for plan in (plan_of(book.txns), plan_of(matching_transactions(recent, stored).rows)):
        assert "GreaterThanOrEqual(date,2024-03-01)" in plan
    for row in book.summaries().collect():
        query = ["groceries this month", "dining this week", "zzz this month"][row.question_id]
        matched, fallback = brute.matching(query, make_rows(6), set(KNOWN_MERCHANTS))
        assert row.net == brute.summary(matched)["net"] and row.used_fallback == fallback


def test_long_and_repeated_questions(spark):
    rows = make_rows(3, 60)
    filler = " ".join(f"{a}{b}q" for a in "bcdfgh" for b in "bcdfghjklm")
    questions = [f"{filler} groceries {filler} this year"] * 50 + ["dining this year"]
    found = AnswerBook.open(asked(spark, questions), frame(spark, rows)).summaries().collect()
    for row in found:
        matched, _ = brute.matching(questions[row.question_id], rows, set(KNOWN_MERCHANTS))
        assert row.total_spend == brute.summary(matched)["total_spend"]
    assert len(found) == 51


def test_questions_that_share_their_hits_share_a_set(spark):
    rows = make_rows(7, 80)
    questions = [f"amazing{chr(97 + i % 26)}{chr(97 + i // 26)} dining this year" for i in range(400)]
    questions += ["zzz this year", "yyy this year"]
    txns = frame(spark, rows)
    book = AnswerBook.open(asked(spark, questions), txns)
    one = AnswerBook.open(asked(spark, questions[:1]), txns)
    assert book.asked.count() == 402
    assert book.kept.count() == one.kept.count() > 0
    found = matching_transactions(asked(spark, questions), txns)
    assert found.members.count() == 402
    assert found.members.select("hits", "window").distinct().count() == 2
    expected, _ = brute.matching(questions[3], rows, set(KNOWN_MERCHANTS))
    assert found.rows.filter("hits != ''").count() == len(expected)
    some = found.of_questions(asked(spark, questions).filter("question_id = 5"))
    assert sorted(r.note for r in some.collect()) == sorted(r["note"] for r in expected)


def test_a_null_question_is_one_without_keywords(spark):
    rows = make_rows(8, 40)
    txns, questions = frame(spark, rows), asked(spark, [None, "dining"])
    summaries = {r.question_id: r for r in AnswerBook.open(questions, txns).summaries().collect()}
    assert set(summaries) == {0, 1}
    assert summaries[0].net == brute.summary(rows)["net"] and not summaries[0].used_fallback
    mine = matching_transactions(questions, txns).of_questions().filter("question_id = 0").collect()
    assert len(mine) == len(rows) and {r.used_fallback for r in mine} == {False}


def test_newest_first(spark):
    rows = make_rows(4, 40)
    dates = [r.date for r in newest_first(frame(spark, rows)).collect()]
    known = [d for d in dates if d]
    assert known == sorted(known, reverse=True)
    assert all(d is None for d in dates[len(known) :])


def test_ties_are_ranked_by_name(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, Decimal("5.00"), "C", name, "") for name in "hgfedcba"]
    txns = spark.createDataFrame(rows, SCHEMA).withColumn("question_id", F.lit(1))
    names = [r.merchant for r in top_merchants(txns, ["question_id"]).orderBy("rank").collect()]
    assert names == list("abcde")


def test_plans_have_no_cross_join_and_no_python(spark, case):
    _, txns, known = case
    book = AnswerBook.open(asked(spark), txns, known)
    plans = {
        "rows": plan_of(matching_transactions(asked(spark), txns, known).rows),
        "one": plan_of(transactions_for(QUESTIONS[0], txns, known)),
        "summaries": plan_of(book.summaries()),
        "merchants": plan_of(book.top_merchants()),
        "evaluated": plan_of(book.evaluated()),
    }
    for name, plan in plans.items():
        for bad in ("Cartesian", "NestedLoop", "Python", "ArrowEval"):
            assert bad not in plan, (name, bad)
    assert "WindowGroupLimit" in plan_of(top_merchants(book.cells, ["window"]))
    assert "Join" not in plans["one"]


def test_date_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "txns")
    frame(spark, make_rows(5)).write.parquet(path)
    plan = plan_of(transactions_for("groceries this month", spark.read.parquet(path)))
    assert "GreaterThanOrEqual(date,2024-03-01)" in plan
