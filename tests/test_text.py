import hashlib

import pytest
from pyspark.sql import functions as F

from tallymill.functions.money import amount_text, parse_amount, parse_date, spent_sentence
from tallymill.functions.text import _plain_numbers, number_tokens, pseudonym, speech_text, trimmed


def apply(spark, function, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string")
    rows = df.select("n", function(F.col("t"))).orderBy("n").collect()
    return [row[1] for row in rows]


VOICE = [
    ("You spent $1,200.50 today", "You spent 1,200.50 dollars today"),
    ("$5 and $6.", "5 dollars and 6 dollars."),
    ("on 2024-06-05.", "on June 5, 2024."),
    ("2024-06-05 to 2024-12-31", "June 5, 2024 to December 31, 2024"),
    ("2024-02-30 and 2024-13-01", "2024-02-30 and 2024-13-01"),
    ("0000-01-01", "0000-01-01"),
    ("x2024-06-05 12024-06-05", "x2024-06-05 12024-06-05"),
    ("2024-06-055", "2024-06-055"),
    ("mail a.b+c@x-y.co.uk!", "mail a.b+c at x-y.co.uk!"),
    ("a@b c@d.e", "a@b c@d.e"),
    ("plain", "plain"),
    ("", ""),
    (None, None),
]

WEB = [
    ("You spent $1,200.50", "You spent dollars 1,200 point 50 ."),
    ("₹5 €6 £7 8%", "rupees 5 euros 6 pounds 7 8 percent ."),
    ("a\n\n b", "a. b ."),
    ("One!   Two? Three", "One! Two? Three ."),
    ("1.2.3", "1 point 2.3 ."),
    ("   ", ""),
    ("", ""),
    (None, None),
]


def test_voice_rules(spark):
    assert apply(spark, speech_text, [t for t, _ in VOICE]) == [s for _, s in VOICE]


def test_web_rules(spark):
    spoken = apply(spark, lambda c: speech_text(c, "web"), [t for t, _ in WEB])
    assert spoken == [s for _, s in WEB]


def test_unknown_rules(spark):
    with pytest.raises(ValueError):
        speech_text(F.lit(""), "other")


def test_number_tokens(spark):
    texts = ["$999,999 or 12.5 or 12.5", "1. .5 $ 007", "none", ""]
    assert apply(spark, number_tokens, texts) == [["$999", "999", "12.5"], ["1", "5", "007"], [], []]
    plain = apply(spark, lambda c: number_tokens(c, "normalized"), texts + ["0.50 000 10.0 1,23"])
    assert plain == [["999999", "12.5"], ["1", "5", "7"], [], [], ["0.5", "0", "10", "1", "23"]]


def test_trimmed(spark):
    assert apply(spark, trimmed, ["\t a b \n", "", "  "]) == ["a b", "", ""]


def test_pseudonym(spark):
    assert apply(spark, pseudonym, ["secret"]) == [hashlib.sha256(b"secret").hexdigest()]


def test_dates_and_amounts_from_text(spark):
    dates = apply(spark, parse_date, ["2024-02-29", "2023-02-29", "", "2024", "x", None])
    assert [str(d) for d in dates] == ["2024-02-29"] + ["None"] * 5
    amounts = apply(spark, parse_amount, [" 12.34 ", "1e3", "1.5d", "nan", "", "1,234", "-7"])
    assert [str(a) for a in amounts] == ["12.34", "1000.00", "None", "None", "None", "None", "-7.00"]
    shorts = apply(spark, lambda c: amount_text(parse_amount(c)), ["12.50", "10", "0.05", "-3.10"])
    assert shorts == ["12.5", "10.0", "0.05", "-3.1"]


def test_sentence_has_two_decimals_and_no_grouping(spark):
    df = spark.sql("select cast(1234567.5 as decimal(28,2)) s, 3L n")
    (text,) = df.select(spent_sentence(F.col("s"), F.col("n"))).first()
    assert text == "You spent $1234567.50 across 3 transactions."


def test_plain_numbers_are_those_of_the_patterns_alone(spark):
    tokens = ["$1,200.50", "007", "000", "0", "00.50", "0.0", "10", "100.", "1.0", "$0,012.0100", "5.25", "$5", "20,000"]
    by_pattern = F.col("token")
    for pattern, to in ((r"[$,]", ""), (r"^0+(?=\d)", ""), (r"(\.\d*?)0+$", "$1"), (r"\.$", "")):
        by_pattern = F.regexp_replace(by_pattern, pattern, to)
    rows = spark.createDataFrame([(token,) for token in tokens], "token string")
    found = rows.select(by_pattern.alias("want"), _plain_numbers(F.array("token"))[0].alias("got")).collect()
    assert all(row.got == row.want for row in found)
