"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("category", T.StringType()),
        T.StructField("merchant", T.StringType()),
    ]
)

SYNCED = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amount", MONEY),
    ]
)

FEED = T.StructType(
    [
        T.StructField("amount", T.StringType()),  # a number, or one written as text
        T.StructField("date", T.StringType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField(
            "personal_finance_category",
            T.StructType([T.StructField("primary", T.StringType())]),
        ),
    ]
)

FEED_PAYLOAD = T.StructType([T.StructField("transactions", T.ArrayType(FEED))])

INDEX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

#: The index as it is stored: ``digest`` tells whether a document is the one that was embedded.
STORED_INDEX = T.StructType([*INDEX.fields, T.StructField("digest", T.StringType())])

DAY_CELL = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("amount", T.DecimalType(38, 2)),
        T.StructField("rows", T.LongType()),
    ]
)

REJECT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())]
)

EVALUATION = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("latency", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)
