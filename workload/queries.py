"""Spark side of every registered query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.latency import round_trip_of, steps_of
from tallymill.functions.text import pseudonym, speech_text
from tallymill.functions.windows import WINDOWS, first_days, in_window, start_of
from tallymill.operators import insights
from tallymill.operators.grounding import grounding
from tallymill.operators.inverted import fit_lists, probes_for, recall_of, search
from tallymill.operators.matching import SET, Matches, matching_transactions, newest_first
from tallymill.operators.normalize import normalize
from tallymill.operators.questions import clean_questions, parse_questions
from tallymill.operators.retrieval import context, contexts_for, index_corpus, top_k
from tallymill.operators.trace import latency_lines, round_trips, step_durations
from tallymill.plans.answers import AnswerBook, answer_and_log, evaluation_records, responses
from tallymill.plans.feed import sync
from tallymill.plans.ledger import Ledger
from tallymill.plans.ranges import open_ranges
from tallymill.session import fresh_path, materialize
from tallymill.sources.corpus import read_corpus, read_index, update_index, write_index
from tallymill.sources.evaluations import append_evaluations, read_evaluations
from tallymill.sources.feed import payload_rejects, read_payloads, records_of
from tallymill.sources.transactions import load_transactions, read_synced, write_csv
from tallymill.streaming.feed import batch_sync, rejects_store, stream_texts, sync_stream
from tallymill.streaming.trace import duration_store, durations, write_durations
from workload import tables

Query = Callable[[SparkSession, str], DataFrame]


def _flat(df: DataFrame) -> DataFrame:
    """Amounts as double, dates as text, word lists joined: what both engines can hash."""

    def shown(name: str, kind: str) -> Column:
        value = F.col(name)
        if kind.startswith("decimal"):
            return value.cast("double").alias(name)
        if kind == "date":
            return F.date_format(value, "yyyy-MM-dd").alias(name)
        if kind == "array<string>":
            return F.array_join(value, " ").alias(name)
        return value

    return df.select(*[shown(name, kind) for name, kind in df.dtypes])


def feed_normalize(spark: SparkSession, folder: str) -> DataFrame:
    payloads = tables.feed_payloads(spark, folder)
    return _flat(normalize(records_of(payloads, F.col("payload"))))


def feed_sync_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    raw, synced = fresh_path(spark, "feed"), fresh_path(spark, "synced")
    tables.feed_payloads(spark, folder).write.text(raw)
    return _flat(sync(read_payloads(spark, raw), synced))


def feed_faulty(spark: SparkSession, folder: str) -> DataFrame:
    """What can be read of a feed with planted faults."""
    raw = fresh_path(spark, "feed")
    tables.faulty_payloads(spark, folder).write.text(raw)
    return _flat(normalize(read_payloads(spark, raw)))


def feed_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What cannot be read of it, by reason."""
    raw = fresh_path(spark, "feed")
    tables.faulty_payloads(spark, folder).write.text(raw)
    return payload_rejects(spark, raw).groupBy("reason").agg(F.count("*").alias("n_texts"))


def synced_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions where both files and a synced table are there: the table counts."""
    synced = fresh_path(spark, "synced")
    sync(records_of(tables.feed_payloads(spark, folder), F.col("payload")), synced)
    return _flat(load_transactions(spark, fresh_path(spark, "csv"), synced))


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    write_csv(tables.described_transactions(spark, folder), path)
    never_synced = fresh_path(spark, "synced")
    return _flat(load_transactions(spark, path, never_synced))


def synced_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two syncs: what a reader has who came between, and what one has who comes after."""
    path = fresh_path(spark, "synced")
    payloads = tables.feed_payloads(spark, folder)
    sync(records_of(payloads, F.col("payload")), path)
    between = load_transactions(spark, fresh_path(spark, "csv"), path)
    later = records_of(tables.faulty_payloads(spark, folder), F.col("payload"))
    after = sync(later, path)

    def told(version: int, rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("category").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))
        return counted.withColumn("version", F.lit(version))

    return _flat(told(1, between).unionByName(told(2, after)))


def _streamed(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Stores of the faulty feed that arrives in three batches of files, the first of them twice."""
    raw = fresh_path(spark, "feed")
    synced, rejects = fresh_path(spark, "synced"), fresh_path(spark, "rejects")
    state = fresh_path(spark, "state")
    # One task writes, and later reads, a file: their number follows that of shuffle partitions.
    per_batch = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    tables.faulty_payloads(spark, folder).repartition(3 * per_batch).write.text(raw)
    texts = stream_texts(spark, raw, files_per_batch=per_batch)
    sync_stream(texts, synced, rejects, state).awaitTermination()
    again = spark.read.text(raw).select(F.col("value").alias("body"))
    batch_sync(synced, rejects, state)(again, 0)
    return synced, rejects


def feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    synced, _ = _streamed(spark, folder)
    return _flat(read_synced(spark, synced))


def feed_stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, rejects = _streamed(spark, folder)
    found = rejects_store(spark, rejects).read()
    return found.groupBy("reason").agg(F.count("*").alias("n_texts"))


def question_parse(spark: SparkSession, folder: str) -> DataFrame:
    starts = first_days(tables.transactions(spark, folder))
    parsed = parse_questions(tables.questions(spark, folder), tables.KNOWN)
    first_day = start_of(F.col("window"), starts).alias("first_day")
    return _flat(
        parsed.select("question_id", "window", first_day, "keywords", "merchant_keywords")
    )


def conversation_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_questions(clean_questions(tables.conversation_questions(spark, folder)))
    return _flat(parsed.select("question_id", "query", "window", "keywords"))


def match_window(window: str, spark: SparkSession, folder: str) -> DataFrame:
    txns = tables.transactions(spark, folder)
    inside = txns.filter(in_window(F.col("date"), window, first_days(txns)))
    return _flat(inside.agg(*_row_measures()))


def _row_measures(amount: Column | None = None) -> list[Column]:
    return [
        F.count("*").alias("n_rows"),
        (F.sum("amount") if amount is None else amount).alias("amount"),
        F.min("date").alias("oldest"),
        F.max("date").alias("newest"),
    ]


#: Bits of the lower half of an amount: neither half's sum overflows below 2^33 rows.
HALF_BITS = 30


def _with_halves(rows: DataFrame) -> DataFrame:
    """rows(amount decimal(18,2), ..) with ``high`` and ``low``, the cents as two whole numbers."""
    cents = (F.col("amount") * 100).cast("long")
    low = cents.bitwiseAND(F.lit((1 << HALF_BITS) - 1).cast("long"))
    return rows.withColumns({"high": F.shiftright(cents, HALF_BITS), "low": low})


def _sum_of_halves() -> Column:
    """The sum of the amounts of :func:`_with_halves`, of the type and value of a plain sum."""
    high, low = (F.sum(half).cast("decimal(20,0)") for half in ("high", "low"))
    cents = high * F.lit(1 << HALF_BITS).cast("decimal(10,0)") + low
    return (cents * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(28,2)")


def _matches(spark: SparkSession, folder: str, what: Column, known=tables.KNOWN) -> Matches:
    asked = tables.window_questions(spark, folder, what)
    return matching_transactions(asked, tables.transactions(spark, folder), known)


def _match_summary(found: Matches) -> DataFrame:
    """Measures of the rows of each question, taken once for all that share a set."""
    measured = found.rows.groupBy(*SET).agg(*_row_measures())
    return _flat(found.members.join(measured, SET).drop(*SET))


def match_keywords(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("ECONOMY", "ring or gear", "promo rod", "list", "arg")])
    word = F.element_at(words, (F.col("p_partkey") % 5 + 1).cast("int"))
    return _match_summary(_matches(spark, folder, word, known=()))


def match_known_merchant(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("small bolt", "red gizmo", "large ring")])
    word = F.element_at(words, (F.col("p_partkey") % 3 + 1).cast("int"))
    return _match_summary(_matches(spark, folder, word))


def match_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _match_summary(_matches(spark, folder, F.concat(F.lit("xylophone "), F.col("p_brand"))))


def recent_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each set of equal answers, named after the first question that has it."""
    found = _matches(spark, folder, F.lit("widget or promo"))
    first = found.members.groupBy(*SET).agg(F.min("question_id").alias("question_id"))
    rows = found.rows.join(first, SET).drop(*SET)
    return _flat(newest_first(rows, ["question_id"]))


def recent_of_some(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the rows of all questions, about all windows, listed question by question.

    A row is listed for very many questions, and a sum of decimals of this size makes objects
    for each of them: the amounts are listed and summed as two whole numbers.
    """
    found = _matches(spark, folder, F.lit("widget or promo"))
    listed = replace(found, rows=_with_halves(found.rows)).of_questions()
    measures = _row_measures(_sum_of_halves())
    return _flat(listed.groupBy("question_id", "used_fallback").agg(*measures))


def _book(spark: SparkSession, folder: str) -> AnswerBook:
    return AnswerBook.open(
        tables.questions(spark, folder), tables.transactions(spark, folder), tables.KNOWN
    )


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_book(spark, folder).summaries())


def category_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_book(spark, folder).category_breakdown())


def top_merchants(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_book(spark, folder).top_merchants())


def template_answer(spark: SparkSession, folder: str) -> DataFrame:
    return _book(spark, folder).answers()


def answer_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_book(spark, folder).evaluated())


def answer_responses(spark: SparkSession, folder: str) -> DataFrame:
    evaluated = _book(spark, folder).evaluated()
    answered = responses(evaluated, round_trips(tables.trace(spark, folder)))
    return answered.withColumn("latency_ms", F.col("latency_ms").cast("double"))


def _range_book(spark: SparkSession, folder: str) -> AnswerBook:
    asked = tables.range_questions(spark, folder)
    return open_ranges(asked, tables.transactions(spark, folder), tables.KNOWN)


def range_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_range_book(spark, folder).summaries())


def range_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_range_book(spark, folder).category_breakdown())


def ledger_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary from sums that were kept up to date over batches, one of them repeated."""
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    batches = tables.transaction_batches(spark, folder, 4)
    for at, batch in enumerate(batches):
        ledger.add(batch, "bank", at, most_parts=2)
    ledger.add(batches[1], "bank", 1)
    return _flat(ledger.book(tables.questions(spark, folder), tables.KNOWN).summaries())


def retrieve_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search again, in inverted lists with distance bounds."""
    vectors = tables.vectors(spark, folder)
    lists = fit_lists(vectors.withColumnRenamed("query_id", "id"))
    found = search(vectors, lists, probes=max(1, len(lists.centroids) // 8), exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))


def retrieve_lists_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the nearest lists alone hold nine of ten of the exact rows."""
    vectors = materialize(tables.whole_vectors(spark, folder), "vectors")
    index = vectors.withColumnRenamed("query_id", "id")
    lists = fit_lists(index)
    found = search(vectors, lists, probes=probes_for(vectors, lists))
    recall = recall_of(found, top_k(vectors, index))
    return vectors.agg(F.count("*").alias("n_queries")).withColumn("reached", F.lit(recall >= 0.9))


def retrieve_topk(spark: SparkSession, folder: str) -> DataFrame:
    index = tables.vectors(spark, folder).withColumnRenamed("query_id", "id")
    found = top_k(tables.vectors(spark, folder), index)
    return found.withColumn("similarity", F.round("similarity", 6))


def retrieve_context(spark: SparkSession, folder: str) -> DataFrame:
    index = materialize(tables.vector_index(spark, folder), "index")
    return context(top_k(tables.whole_vectors(spark, folder), index), index)


def retrieve_by_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text to embedder to index to context, for all documents and all questions."""
    path = fresh_path(spark, "index")
    docs = tables.corpus(spark, folder)
    write_index(index_corpus(docs, _letter_counts), path)
    questions = tables.document_questions(spark, folder)
    return contexts_for(questions, read_index(spark, path), _letter_counts)


def _write_files(docs: DataFrame, folder: str) -> None:
    """Each document as a file of its own, named so that a repeated task rewrites it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source, text in zip(batch["source"], batch["text"]):
                with files.open_output_stream(f"{root}/{source}") as out:
                    out.write(text.encode())
            yield batch[["source"]]

    docs.mapInPandas(write, "source string").write.format("noop").mode("overwrite").save()


def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "corpus")
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    docs = tables.named_files(spark, folder)
    files, root = pyarrow.fs.FileSystem.from_uri(uri)
    files.create_dir(root, recursive=True)
    _write_files(docs, uri)
    return read_corpus(spark, path)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_counts() -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an embedding model: how often each letter occurs."""
    return lambda texts: np.array([[text.count(c) for c in LETTERS] for text in texts])


def corpus_index(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "index")
    write_index(index_corpus(tables.corpus(spark, folder), _letter_counts), path)
    counts = F.transform("embedding", lambda x: x.cast("long").cast("string"))
    return read_index(spark, path).select(
        "id", "source", "text", F.array_join(counts, " ").alias("embedding")
    )


def index_update(spark: SparkSession, folder: str) -> DataFrame:
    """An index of other and fewer documents, brought up to date."""
    path = fresh_path(spark, "index")
    docs = tables.corpus(spark, folder)
    number = F.split_part("id", F.lit("-"), F.lit(-1)).cast("long")
    older = docs.filter(number % 3 != 0).withColumn(
        "text", F.when(number % 5 == 0, F.reverse("text")).otherwise(F.col("text"))
    )
    gone = docs.withColumn("id", F.concat(F.lit("old-"), "id")).filter(number % 7 == 0)
    for version in (older.unionByName(gone), docs):
        update_index(version, path, lambda some: index_corpus(some, _letter_counts))
    counts = F.transform("embedding", lambda x: x.cast("long").cast("string"))
    return read_index(spark, path).select(
        "id", "source", "text", F.array_join(counts, " ").alias("embedding")
    )


def _grounded(mode: str, spark: SparkSession, folder: str) -> DataFrame:
    answers = tables.order_answers(spark, folder)
    return grounding(answers, tables.order_evidence(spark, folder), mode)


def grounding_query(mode: str, spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_grounded(mode, spark, folder))


def log_append_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "log")
    question = F.concat(F.lit("order "), F.col("question_id").cast("string"))
    grounded = _grounded("exact", spark, folder).withColumn("query", question)
    records = materialize(evaluation_records(grounded, latency_lines_query(spark, folder)), "records")
    append_evaluations(records.filter("passed"), path)
    append_evaluations(records.filter("not passed"), path)
    return read_evaluations(spark, path)


def step_durations_query(spark: SparkSession, folder: str) -> DataFrame:
    return step_durations(tables.trace(spark, folder)).drop("ts")


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Step durations of events that arrive out of order, a file at a time.

    They come up to six days late, and the watermark waits eight. Two steps of a trace of its
    own come last, so that the watermark passes all others.
    """
    raw, out = fresh_path(spark, "trace"), fresh_path(spark, "durations")
    steps = tables.trace(spark, folder).filter("ts IS NOT NULL")
    day = F.unix_date(F.col("ts").cast("date"))
    arrival = materialize(
        steps.withColumn("file", F.floor((day + F.pmod(F.xxhash64("seq"), F.lit(7))) / 6)), "arrival"
    )
    first, last = arrival.agg(F.min("file"), F.max("file")).first()
    for file in range(first, last + 1):
        arrival.filter(F.col("file") == file).drop("file").coalesce(1).write.parquet(f"{raw}/{file}")
    for more in (60, 61):
        end = steps.agg(F.max("ts").alias("ts")).select(
            F.lit(-1).cast("long").alias("trace_id"), F.lit(more).cast("long").alias("seq"),
            F.lit("end").alias("step"), F.date_add("ts", more).cast("timestamp").alias("ts"),
        )
        end.coalesce(1).write.parquet(f"{raw}/{last + more}")
    schema = arrival.drop("file").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{raw}/*")
    write_durations(durations(stream, "8 days"), out, fresh_path(spark, "state")).awaitTermination()
    found = duration_store(spark, out).read().filter("step <> 'end'")
    return found.select(F.col("trace_id").cast("long").alias("trace_id"), "seq", "step", "position", "seconds")


def round_trips_query(spark: SparkSession, folder: str) -> DataFrame:
    return round_trips(tables.trace(spark, folder))


def latency_lines_query(spark: SparkSession, folder: str) -> DataFrame:
    return latency_lines(tables.trace(spark, folder))


def latency_parse(spark: SparkSession, folder: str) -> DataFrame:
    lines = latency_lines_query(spark, folder)
    return lines.select(
        "trace_id",
        round_trip_of(F.col("latency")).alias("round_trip"),
        F.posexplode(steps_of(F.col("latency"))).alias("at", "part"),
    ).select("trace_id", "round_trip", "at", "part.step", "part.seconds")


def answer_log(spark: SparkSession, folder: str) -> DataFrame:
    """Questions answered and logged with the latency of their traces, read back."""
    path = fresh_path(spark, "log")
    answer_and_log(
        tables.questions(spark, folder),
        tables.transactions(spark, folder),
        path,
        tables.KNOWN,
        trace=tables.trace(spark, folder),
    )
    return read_evaluations(spark, path)


def answer_log_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The same questions answered and logged twice under one name."""
    path = fresh_path(spark, "log")
    asked, txns = tables.questions(spark, folder), tables.transactions(spark, folder)
    for _ in range(2):
        answer_and_log(asked, txns, path, tables.KNOWN, trace=tables.trace(spark, folder), run="all")
    return read_evaluations(spark, path)


def speech(rules: str, spark: SparkSession, folder: str) -> DataFrame:
    spoken = speech_text(F.col("text"), rules).alias("spoken")
    return tables.spoken_texts(spark, folder).select("text_id", spoken)


def pseudonymize(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "customer").select(
        "c_custkey", pseudonym(F.col("c_name")).alias("token")
    )


def report(build: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    return _flat(build(tables.transactions(spark, folder)))


RULES = {"widget": "Shopping", "gear": "Transportation", "red": "Dining", "rod": "Utilities"}


def _rules(txns: DataFrame) -> DataFrame:
    return (
        insights.rule_categorize(txns, RULES)
        .groupBy("merchant", "category", "rule_category")
        .agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))
    )


def _spikes(txns: DataFrame) -> DataFrame:
    return insights.spend_spikes(txns).select(
        "category",
        "month",
        "spend",
        F.round("usual", 4).alias("usual"),
        F.round("deviation", 4).alias("deviation"),
        "is_spike",
    )


def _unusual(txns: DataFrame) -> DataFrame:
    """Limits of merchants and months, and whether exactly so many earlier charges lie below.

    The exact shares are counted from all charges, beside the sketches.
    """
    limits = materialize(insights.usual_limits(insights.charge_sketches(txns)), "limits")
    charges = txns.filter("category <> 'Income'").select(
        "merchant", F.trunc("date", "MM").alias("charged"), F.col("amount").cast("double").alias("amount")
    )
    later = F.explode(F.sequence(F.add_months("charged", 1), F.add_months("charged", 12), F.expr("INTERVAL 1 MONTH")))
    history = charges.select("merchant", later.alias("month"), "amount")
    limit = F.col("usual_limit")
    counted = history.join(limits, ["merchant", "month"]).groupBy("merchant", "month", "history").agg(
        F.avg((F.col("amount") < limit).cast("int")).alias("below"),
        F.avg((F.col("amount") <= limit).cast("int")).alias("up_to"),
    )
    within = (F.col("below") <= 0.99 + 0.02) & (F.col("up_to") >= 0.99 - 0.02)
    return counted.select("merchant", "month", "history", within.alias("within_error"))


def _shares(txns: DataFrame) -> DataFrame:
    return insights.merchant_share(txns).withColumn("share", F.round("share", 9))


def _default_rules(spark: SparkSession, folder: str) -> DataFrame:
    ruled = insights.rule_categorize(tables.ruled_transactions(spark, folder))
    return _flat(
        ruled.groupBy("merchant", "category", "rule_category").agg(
            F.count("*").alias("n_rows"), F.sum("amount").alias("amount")
        )
    )


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "feed_normalize": feed_normalize,
        "feed_sync_roundtrip": feed_sync_roundtrip,
        "feed_faulty": feed_faulty,
        "feed_rejects": feed_rejects,
        "synced_choice": synced_choice,
        "synced_versions": synced_versions,
        "feed_stream": feed_stream,
        "feed_stream_rejects": feed_stream_rejects,
        "csv_roundtrip": csv_roundtrip,
        "question_parse": question_parse,
        "conversation_parse": conversation_parse,
    }
    for window in WINDOWS:
        found[f"match_{window.replace(' ', '_')}"] = partial(match_window, window)
    found |= {
        "match_keywords": match_keywords,
        "match_known_merchant": match_known_merchant,
        "match_fallback": match_fallback,
        "recent_transactions": recent_transactions,
        "recent_of_some": recent_of_some,
        "summary": summary,
        "category_breakdown": category_breakdown,
        "top_merchants": top_merchants,
        "template_answer": template_answer,
        "range_summary": range_summary,
        "range_breakdown": range_breakdown,
        "ledger_summary": ledger_summary,
        "answer_batch": answer_batch,
        "answer_responses": answer_responses,
        "retrieve_topk": retrieve_topk,
        "retrieve_lists": retrieve_lists,
        "retrieve_lists_recall": retrieve_lists_recall,
        "retrieve_context": retrieve_context,
        "retrieve_by_text": retrieve_by_text,
        "corpus_scan": corpus_scan,
        "corpus_index": corpus_index,
        "index_update": index_update,
        "grounding_exact": partial(grounding_query, "exact"),
        "grounding_normalized": partial(grounding_query, "normalized"),
        "log_append_scan": log_append_scan,
        "answer_log": answer_log,
        "answer_log_repeated": answer_log_repeated,
        "step_durations": step_durations_query,
        "trace_stream": trace_stream,
        "round_trips": round_trips_query,
        "latency_lines": latency_lines_query,
        "latency_parse": latency_parse,
        "speech_text": partial(speech, "voice"),
        "speech_text_web": partial(speech, "web"),
        "pseudonymize": pseudonymize,
        "compare_periods": partial(report, insights.compare_periods),
        "monthly_trend": partial(report, insights.monthly_trend),
        "merchant_share": partial(report, _shares),
        "recurring_merchants": partial(report, insights.recurring_merchants),
        "spend_spikes": partial(report, _spikes),
        "unusual_charges": partial(report, _unusual),
        "rule_categorize": partial(report, _rules),
        "rule_categorize_default": _default_rules,
    }
    return found
