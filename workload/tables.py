"""Inputs in the engine's own shapes, derived from whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.money import amount_text
from tallymill.operators.grounding import evidence_text
from tallymill.operators.normalize import CATEGORY_OF_CODE

KNOWN = ("bolt", "gizmo")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _line_items(spark: SparkSession, folder: str) -> DataFrame:
    items, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey)


def _transaction_columns() -> list[Column]:
    income = F.col("l_returnflag") == "R"
    return [
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.when(income, "Income").otherwise(F.col("p_type")).alias("category"),
        F.col("p_name").alias("merchant"),
    ]


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return _line_items(spark, folder).select(*_transaction_columns())


def described_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with an id and a description full of quotes and commas."""
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    return _line_items(spark, folder).select(
        F.concat(F.lit("TXN-"), order, F.lit("-"), line).alias("transaction_id"),
        F.concat(F.lit('order "'), order, F.lit('", line '), line).alias("description"),
        *_transaction_columns(),
    )


#: Merchants that rules may take for others, and one that a rule means.
RULE_MERCHANTS = ("Columbus Business Cafe", "Training Center", "City Bus", "UBER trip", "Star Bucks")


def ruled_transactions(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(name) for name in RULE_MERCHANTS], F.lit(None).cast("string"))
    name = F.get(names, (F.col("l_partkey") % (len(RULE_MERCHANTS) + 1)).cast("int"))
    columns = [c for c in _transaction_columns()][:3]
    return _line_items(spark, folder).select(*columns, name.alias("merchant"))


def order_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, evidence): the transactions of each order as evidence texts."""
    rows = _line_items(spark, folder).select("l_orderkey", *_transaction_columns())
    return rows.select(
        F.col("l_orderkey").alias("question_id"),
        evidence_text(rows.drop("l_orderkey")).alias("evidence"),
    )


def order_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, answer): one sentence per order, right or wrong in several ways."""
    orders = (
        _line_items(spark, folder)
        .select("l_orderkey", *_transaction_columns())
        .groupBy("l_orderkey")
        .agg(
            F.sum("amount").alias("total"),
            F.count("*").alias("n"),
            F.max("amount").alias("most"),
            F.max("date").alias("newest"),
        )
    )
    count, kind = F.col("n").cast("string"), F.col("l_orderkey") % 5
    total, most = F.col("total").cast("string"), amount_text(F.col("most"))
    newest = F.col("newest").cast("string")
    grouped = F.format_number("most", 2)
    answer = (
        F.when(
            kind == 0,
            F.concat(F.lit("You spent $"), total, F.lit(" across "), count, F.lit(" transactions.")),
        )
        .when(kind == 1, F.concat(F.lit("Up to "), newest, F.lit(" you spent "), total, F.lit(".")))
        .when(kind == 2, F.concat(F.lit("The largest of "), count, F.lit(" is "), most, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("The largest is $"), grouped, F.lit(" on "), newest, F.lit(".")))
        .otherwise(F.concat(F.lit("Ask me.too@shop"), count, F.lit(".example on "), newest))
    )
    return orders.select(F.col("l_orderkey").alias("question_id"), answer.alias("answer"))


def feed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(payload): bank-feed responses as JSON text, one per line item."""
    return _payloads(spark, folder).select("payload")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(payload, kind): with the number of the fault that may be made in it."""
    supplier = F.col("l_suppkey")
    codes = F.array(*[F.lit(code) for code in CATEGORY_OF_CODE], F.lit("BANK_FEES"))
    code = F.get(codes, (F.col("l_partkey") % 12).cast("int"))
    amount = F.col("l_extendedprice")
    record = F.struct(
        F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("amount"),
        F.when(supplier % 17 == 0, "")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("date"),
        F.when(supplier % 10 == 1, "")
        .when(supplier % 10 > 1, F.col("p_name"))
        .alias("merchant_name"),
        F.when(code.isNotNull(), F.struct(code.alias("primary"))).alias(
            "personal_finance_category"
        ),
    )
    payload = F.to_json(F.struct(F.array(record).alias("transactions")))
    kind = (F.col("l_orderkey") % 11).alias("kind")
    return _line_items(spark, folder).select(payload.alias("payload"), kind)


def faulty_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(payload): the feed with amounts as text, amounts that are none, and broken texts."""
    body, kind = F.col("payload"), F.col("kind")
    number = '"amount":(-?[0-9.E]+)'
    as_text = F.regexp_replace(body, number, '"amount":"$1"')
    no_number = F.regexp_replace(body, number, '"amount":"twelve"')
    cut = F.substr(body, F.lit(1), F.length(body) - 4)
    payload = (
        F.when(kind == 0, as_text)
        .when(kind == 1, no_number)
        .when(kind == 2, cut)
        .when(kind == 3, F.lit("[1, 2]"))
        .when(kind == 4, F.lit("{}"))
        .otherwise(body)
    )
    return _payloads(spark, folder).select(payload.alias("payload"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, query): one question per part, in the words of the transactions."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_partkey") % 12
    texts = [
        F.concat(F.lit("How much did I spend on "), noun, F.lit(" last month")),
        F.concat(F.lit("Spending on "), F.lower("p_type"), F.lit(" this month")),
        F.lit("Top merchant for the last year"),
        F.lit("Total spending last week"),
        F.lit("Show income this month"),
        F.concat("p_name", F.lit(" this year")),
        F.lit("Compare spending this month vs last month"),
        F.concat(noun, F.lit(" this week")),
        F.concat(noun, F.lit(" yesterday")),
        F.lit("List transactions today"),
        F.concat(F.lit("Recent transactions at "), "p_brand"),
        F.concat(F.lit("Spending on "), "p_type", F.lit(" or "), "p_name"),
    ]
    chosen = F.element_at(F.array(*texts), (kind + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 53 != 0, chosen)  # some questions are unknown
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"), text.alias("query")
    )


#: Every window there is; without a phrase a question covers all time.
PHRASE_OF = (
    "last month", "this month", "last week", "this week", "today", "yesterday", "last year",
    "this year", "ever",
)


def window_questions(spark: SparkSession, folder: str, what: Column) -> DataFrame:
    """(question_id, query): one question per part, about each window in turn."""
    phrases = F.array(*[F.lit(phrase) for phrase in PHRASE_OF])
    phrase = F.element_at(phrases, (F.col("p_partkey") % len(PHRASE_OF) + 1).cast("int"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"), F.concat_ws(" ", what, phrase).alias("query")
    )


RANGE_WORDS = ("widget or promo", "ECONOMY", "small bolt", "xylophone", "list")


def range_questions(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, query, first_day, last_day): a question about some days from each order on.

    Some have no first or no last day, or a last day before the first.
    """
    key = F.col("o_orderkey")
    words = F.array(*[F.lit(word) for word in RANGE_WORDS])
    first = F.col("o_orderdate").cast("date")
    days = F.when(key % 29 == 0, -3).otherwise(key % 400).cast("int")
    return table(spark, folder, "orders").select(
        key.alias("question_id"),
        F.element_at(words, (key % len(RANGE_WORDS) + 1).cast("int")).alias("query"),
        F.when(key % 19 != 0, first).alias("first_day"),
        F.when(key % 23 != 0, F.date_add(first, days)).alias("last_day"),
    )


def transaction_batches(spark: SparkSession, folder: str, n: int) -> list[DataFrame]:
    """The transactions in batches by their order, whatever their dates."""
    rows = _line_items(spark, folder)
    return [rows.filter(F.col("l_orderkey") % n == at).select(*_transaction_columns()) for at in range(n)]


def conversation_questions(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.concat_ws("-", "conv_id", "turn")
    return table(spark, folder, "conversations").select(
        turn.alias("question_id"), F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("query")
    )


def trace(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("trace_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("step"),
        # Some steps have no time.
        F.when(F.col("event_id") % 97 != 0, F.col("ts").cast("timestamp")).alias("ts"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, embedding): whole vectors, some of them without direction.

    Every 17th is all zero, NaN in its first place, or null in its first place, in turn.
    """
    key = F.col("vec_id")
    first = F.when(key % 3 == 1, F.lit(float("nan"))).cast("float")
    spoilt = F.concat(F.array(first), F.slice("embedding", 2, 10_000))
    zero = F.transform("embedding", lambda x: x * 0)
    odd = F.when(key % 3 == 0, zero).otherwise(spoilt)
    return table(spark, folder, "embeddings").select(
        key.alias("query_id"), F.when(key % 17 == 0, odd).otherwise(F.col("embedding")).alias("embedding")
    )


def whole_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


def vector_index(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, text, embedding): every document, with a vector or an empty one."""
    found = whole_vectors(spark, folder)
    docs = table(spark, folder, "documents")
    return docs.join(found, found.query_id == docs.doc_id, "left").select(
        F.col("doc_id").alias("id"), "source", "text", "embedding"
    )


def document_questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text): every turn of every conversation as a question."""
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text"
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, text): every document as a knowledge file."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select(
        name.alias("id"), F.concat(name, F.lit(".md")).alias("source"), "text"
    )


#: Names as people give them: blanks, signs, and marks that readers take for hidden files.
ODD_NAMES = ("doc {}.md", "_doc-{}.md", ".doc-{}.md", "doc+{}%.md", "doc-{}.v2.md")


def named_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text): documents under odd names, some of them empty."""
    key = F.col("doc_id").cast("string")
    names = [
        F.concat(F.lit(before), key, F.lit(after))
        for before, after in (name.split("{}") for name in ODD_NAMES)
    ]
    source = F.element_at(F.array(*names), (F.col("doc_id") % len(names) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("text"))
    return table(spark, folder, "documents").select(source.alias("source"), text.alias("text"))


def spoken_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(text_id, text): answers and whole documents."""
    answers = order_answers(spark, folder).select(
        F.concat(F.lit("answer-"), F.col("question_id").cast("string")).alias("text_id"),
        F.col("answer").alias("text"),
    )
    return answers.unionByName(
        corpus(spark, folder).select(F.col("id").alias("text_id"), "text")
    )
