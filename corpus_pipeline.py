"""A training-data pipeline: five stages from raw documents to token files.

Each stage takes the documents its predecessor kept and returns a table that is written as
Parquet and read again; the one before is then deleted. All but the last return the columns of
``documents``, and other columns that a table may have, whatever their names.

Null, empty and blank texts have no words and go with the first stage. A null source is a source
of its own there and in the mix, and a null id sorts first. Equal rows are near duplicates: one
stays. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import decontaminate, jaccard_join, mixing, quality_rules, token_files
from tallymill.llm.common import table
from tallymill.session import bound_arrow_batches, discard, materialize

#: Whole documents that go to Python at a time, or come back.
BATCH_ROWS = 1_000
#: Fewer in the last stage, as its workers also hold what the stages before left behind.
TOKEN_ROWS = 500

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source is not rejected."""
    bound_arrow_batches(spark, BATCH_ROWS)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    bound_arrow_batches(spark, BATCH_ROWS)
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly benchmark go.

    ``n_chars`` follows the text where it was cut.
    """
    bound_arrow_batches(spark, BATCH_ROWS)
    rest = [name for name in docs.columns if name != "text"]
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), carry=rest)
    clean = decontaminate.removed(found.withColumn("row", F.struct("row", "runs")))

    def column(name: str):
        if name == "text":
            return F.col("text")
        value = F.col("row.row").getField(name)
        if name == "n_chars":
            value = F.when(F.size("row.runs") > 0, F.length("text")).otherwise(value)
        return value.cast(docs.schema[name].dataType).alias(name)

    return clean.select(*[column(name) for name in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    bound_arrow_batches(spark, BATCH_ROWS)
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and each document's place and checksum as read back from them."""
    bound_arrow_batches(spark, TOKEN_ROWS)
    return token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", without_benchmark),
    ("mix_sources", mixed),
    ("token_files", tokens),
]

#: No SQL for suffix automata, MinHash or tokenizers; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
