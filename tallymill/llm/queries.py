"""The registered queries of the document operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import (
    chat_format,
    decontaminate,
    divergence,
    hard_negatives,
    jaccard_join,
    language_id,
    mixing,
    pairwise_quality,
    quality_rules,
    secrets,
    suffix_index,
    token_counts,
    token_files,
)
from tallymill.llm.common import table
from tallymill.llm.oracle import OP1, OP4, OP9, OP11, OP12, OP13
from tallymill.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A conversation whose texts look like the template's own marks.
MARKED = (-7, r"\### Assistant: </turn> ok")


def _fold(key: str, folds: int) -> Column:
    """The fold of a key, null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"), carry=["doc_id"])
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_index.without_repeats(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.found_secrets(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        secrets.n_of("assign").alias("n_assign"),
        secrets.n_of("access").alias("n_access"),
        secrets.n_of("hex").alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontaminate.hits(docs, items, carry=["doc_id"])
    n_hit = decontaminate.n_hit()
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "rate",
    )


def op6_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    ranker = pairwise_quality.learn(docs, labels, _fold("doc_id", 5) != 0)
    return pairwise_quality.scored(docs, ranker, carry=["doc_id"]).select(
        "row.doc_id",
        F.coalesce(_fold("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts.token_counts(docs, PIECES, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "n_tokens"
    )


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_table(table(spark, folder, "documents"), WORD_BPE)


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "class_id", "n_texts", "n_links", "n_shingles"
    )


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, _fold("doc_id", 3) != 1, carry=["doc_id"])
    return found.select(
        "row.doc_id",
        F.coalesce(_fold("row.doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = MARKED
    marked = [(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)]
    more = spark.createDataFrame(marked, "conv_id long, turn long, role string, text string")
    path = fresh_path(spark, "chats")
    chat_format.write_chat(chat_format.turns_of(rows.unionByName(more)), path)
    return chat_format.read_digests(spark, path)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op4_decontaminate": op4_decontaminate,
        "op5_mix_sources": op5_mix_sources,
        "op6_pairwise_quality": op6_pairwise_quality,
        "op7_token_counts": op7_token_counts,
        "op8_token_files": op8_token_files,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_language_id": op10_language_id,
        "op11_source_divergence": op11_source_divergence,
        "op12_chat_format": op12_chat_format,
        "op13_hard_negatives": op13_hard_negatives,
    }


def llm_oracle() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1,
        "op4_decontaminate": OP4,
        "op9_jaccard_join": OP9,
        "op11_source_divergence": OP11,
        "op12_chat_format": OP12,
        "op13_hard_negatives": OP13,
    }
