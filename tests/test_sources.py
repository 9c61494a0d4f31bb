import csv
import datetime as dt
import uuid
from decimal import Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators.retrieval import index_corpus
from tallymill.schemas import EVALUATION, SYNCED, TRANSACTION
from tallymill.session import (
    bound_arrow_batches,
    discard,
    fresh_path,
    materialize,
    shared_folder,
)
from tallymill.sources.corpus import (
    CorpusReader,
    read_corpus,
    read_index,
    update_index,
    write_index,
)
from tallymill.sources.evaluations import (
    append_evaluations,
    broken_evaluations,
    evaluation_log,
    read_evaluations,
)
from tallymill.sources.transactions import (
    load_transactions,
    read_csv,
    read_synced,
    write_csv,
    write_synced,
)

ROWS = [
    ("TXN-001", "2024-01-31", 'a "quoted", text', "12.5", "Dining", "Trader Joe's"),
    ("TXN-002", "", "plain", "nan", "NA", "null"),
    ("TXN-003", "2024-02-30", "back\\slash", "1.5d", "None", ""),
    ("TXN-004", "2024", "comma", "1,234", "Income", "N/A"),
    ("TXN-005", "2023-12-01", "rounded", " 2.675 ", "x", "Nan"),
    ("TXN-006", "2023-12-02", "big", "1e3", "x", "y"),
]


def write_rows(path):
    with path.open("w", newline="") as handle:
        out = csv.writer(handle)
        out.writerow(TRANSACTION.names)
        out.writerows(ROWS)


def test_csv(spark, tmp_path):
    write_rows(tmp_path / "t.csv")
    rows = {r.transaction_id: r for r in read_csv(spark, str(tmp_path / "t.csv")).collect()}
    first = rows["TXN-001"]
    assert first.description == 'a "quoted", text'
    assert (first.date, first.amount) == (dt.date(2024, 1, 31), Decimal("12.50"))
    assert first.merchant == "Trader Joe's"
    missing = rows["TXN-002"]
    assert (missing.date, missing.amount, missing.category, missing.merchant) == (None,) * 4
    assert (rows["TXN-003"].date, rows["TXN-003"].amount) == (None, None)
    assert rows["TXN-003"].description == "back\\slash"
    assert (rows["TXN-004"].date, rows["TXN-004"].amount) == (None, None)
    assert (rows["TXN-005"].amount, rows["TXN-005"].merchant) == (Decimal("2.68"), "Nan")
    assert rows["TXN-006"].amount == Decimal(1000)


def test_csv_with_line_breaks_in_cells(spark, tmp_path):
    text = ",".join(TRANSACTION.names) + '\nTXN-1,2024-01-01,"two\nlines",1.00,c,m\n'
    (tmp_path / "t.csv").write_text(text)
    (row,) = read_csv(spark, str(tmp_path / "t.csv"), multi_line=True).collect()
    assert row.description == "two\nlines"


def test_csv_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    write_rows(tmp_path / "t.csv")
    first = read_csv(spark, str(tmp_path / "t.csv"))
    write_csv(first, path)
    assert sorted(map(str, read_csv(spark, path).collect())) == sorted(map(str, first.collect()))


def test_synced_table_is_used_once_it_has_rows(spark, tmp_path):
    write_rows(tmp_path / "t.csv")
    csv_path, synced = str(tmp_path / "t.csv"), str(tmp_path / "synced")
    assert read_synced(spark, synced).count() == 0
    assert load_transactions(spark, csv_path, synced).count() == len(ROWS)
    write_synced(spark.createDataFrame([], SYNCED), synced)
    assert load_transactions(spark, csv_path, synced).count() == len(ROWS)
    one = (dt.date(2024, 1, 1), "m", "c", Decimal(1))
    write_synced(spark.createDataFrame([one], SYNCED), synced)
    assert [tuple(r) for r in load_transactions(spark, csv_path, synced).collect()] == [one]
    assert load_transactions(spark, csv_path).count() == len(ROWS)


def test_a_busy_day_is_spread_over_files(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(day, f"m{n}", "c", Decimal(n)) for n in range(2000)]
    path = str(tmp_path / "synced")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_synced(spark.createDataFrame(rows, SYNCED), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(read_synced(spark, path).inputFiles()) > 1
    assert read_synced(spark, path).count() == 2000


def test_corpus_and_index(spark, tmp_path):
    docs = tmp_path / "kb"
    docs.mkdir()
    (docs / "01-a.b.md").write_bytes("# Title\r\n\nline é\r".encode())
    (docs / "02-c.md").write_text("e")
    (docs / "skip.txt").write_text("no")
    corpus = read_corpus(spark, str(docs))
    found = sorted(tuple(r) for r in corpus.collect())
    assert found == [("01-a.b", "01-a.b.md", "# Title\n\nline é\n"), ("02-c", "02-c.md", "e")]

    def model():
        return lambda texts: np.array([[len(t), t.count("e")] for t in texts])

    path = str(tmp_path / "index")
    assert read_index(spark, path).count() == 0
    write_index(index_corpus(corpus, model), path)
    write_index(index_corpus(corpus, model), path)
    index = {r.id: r.embedding for r in read_index(spark, path).collect()}
    assert index == {"01-a.b": [16.0, 2.0], "02-c": [1.0, 1.0]}


def test_an_index_is_kept_up_to_date(spark, tmp_path):
    path, calls = str(tmp_path / "index"), tmp_path / "calls"
    calls.mkdir()

    def model():
        def encode(texts):
            for text in texts:
                (calls / uuid.uuid4().hex).write_text(text)
            return np.array([[len(t), t.count("e")] for t in texts])

        return encode

    def update(*docs):
        for call in calls.iterdir():
            call.unlink()
        rows = spark.createDataFrame([(d, f"{d}.md", text) for d, text in docs], "id string, source string, text string")
        version = update_index(rows.repartition(3), path, lambda df: index_corpus(df, model))
        index = {r.id: (r.text, r.embedding) for r in read_index(spark, path).collect()}
        assert index == {d: (t, [float(len(t or "")), float((t or "").count("e"))]) for d, t in docs}
        return version.number, sorted(call.read_text() for call in calls.iterdir())

    assert update(("a", "one"), ("b", "two"), ("c", None)) == (1, ["", "one", "two"])
    pinned = read_index(spark, path)
    assert update(("a", "one"), ("b", "two"), ("c", None)) == (1, [])
    assert update(("a", "one"), ("b", "two"), ("c", None), ("d", "")) == (2, [""])
    assert update(("a", "one"), ("b", "three"), ("d", "")) == (3, ["three"])
    assert update(("b", "three"), ("d", "")) == (4, [])
    assert update() == (5, [])
    assert {r.id for r in pinned.collect()} == {"a", "b", "c"}


def test_equal_documents_are_indexed_once(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "a.md", "x")] * 3, "id string, source string, text string")
    update_index(rows, path, lambda df: index_corpus(df, lambda: lambda texts: np.ones((len(texts), 2))))
    assert read_index(spark, path).count() == 1


def test_no_file_name_passes_the_driver(spark, tmp_path):
    docs = tmp_path / "many files"
    docs.mkdir()
    for n in range(50):
        (docs / f"doc {n}.md").write_text(str(n))
    partitions = CorpusReader({"folder": "no such folder", "pattern": "*", "partitions": "7"}).partitions()
    assert [part.value for part in partitions] == list(range(7))
    corpus = read_corpus(spark, str(docs), partitions=7)
    assert corpus.rdd.getNumPartitions() == 7
    assert sorted(int(r.text) for r in corpus.collect()) == list(range(50))
    parts = corpus.select(F.spark_partition_id().alias("at")).distinct().count()
    assert parts > 1


def test_corpus_takes_every_file(spark, tmp_path):
    docs = tmp_path / "kb"
    docs.mkdir()
    texts = {"a b.md": "1", "_x.md": "2\r\n", ".y.md": "3", "c+d%20.md": "4", "empty.md": "", "_none.md": ""}
    for name, text in texts.items():
        (docs / name).write_bytes(text.encode())
    (docs / "_skip.txt").write_text("no")
    found = {r.source: (r.id, r.text) for r in read_corpus(spark, str(docs)).collect()}
    assert found == {n: (n.removesuffix(".md"), t.replace("\r\n", "\n")) for n, t in texts.items()}


def test_evaluation_log(spark, tmp_path):
    path = tmp_path / "log"
    record = ("q", "a", "round_trip=1.000s", True, "r")
    append_evaluations(spark.createDataFrame([record], EVALUATION), str(path))
    older = spark.createDataFrame([("q2", "a2", False, "r2")], "query string, answer string, passed boolean, reason string")
    append_evaluations(older, str(path))
    broken = ['{"query": "q4", "ans', "[]", '{"passed": "perhaps"}']
    whole = '{"query": "q3", "answer": "a3", "passed": false}'
    (path / "extra.json").write_text("\n".join(["", whole, *broken, ""]))
    assert sorted(r.body for r in broken_evaluations(spark, str(path)).collect()) == sorted(broken)
    rows = sorted((tuple(r) for r in read_evaluations(spark, str(path)).collect()), key=str)
    assert rows == [
        record,
        ("q2", "a2", None, False, "r2"),
        ("q3", "a3", None, False, None),
    ]


def test_a_log_has_each_append_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    records = spark.createDataFrame([("q", "a", None, True, "r")], EVALUATION)
    for run, batch in (("monday", 0), ("monday", 0), ("monday", 1), ("tuesday", 0), (None, 0), (None, 0)):
        append_evaluations(records, path, run, batch)
    assert read_evaluations(spark, path).count() == 5

    def fails(df, part):
        df.write.json(part)
        raise OSError("lost")

    log = evaluation_log(spark, path)
    monkeypatch.setattr(log, "_write", fails)
    with pytest.raises(OSError):
        log.append(records, "wednesday", 0)
    assert read_evaluations(spark, path).count() == 5
    append_evaluations(records, path, "wednesday", 0, most_parts=2)
    assert read_evaluations(spark, path).count() == 6 and broken_evaluations(spark, path).isEmpty()
    assert len(evaluation_log(spark, path).current().parts) == 1


def test_intermediate_tables_live_in_the_shared_folder(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    kept = materialize(spark.range(5), "x")
    assert shared_folder(spark).removeprefix("file:") in kept.inputFiles()[0]
    assert kept.count() == 5


def test_intermediate_tables_can_be_deleted(spark):
    one, other = materialize(spark.range(5), "x"), materialize(spark.range(6), "x")
    folders = [Path(df.inputFiles()[0].removeprefix("file:")).parent for df in (one, other)]
    discard(one)
    assert [folder.exists() for folder in folders] == [False, True]
    assert other.count() == 6


def test_only_intermediate_tables_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "own")))
    assert (tmp_path / "own").exists()


def test_arrow_batches_are_only_made_smaller(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, rows, want in (("10000", 1_000, "1000"), ("500", 1_000, "500"), ("0", 1_000, "1000")):
            spark.conf.set(name, given)
            bound_arrow_batches(spark, rows)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_a_sync_computes_each_row_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    schema = "date date, merchant string, category string, amount decimal(18,2)"
    rows = [(dt.date(2024, 1, 1 + n % 20), f"m{n}", "c", Decimal(n)) for n in range(50)]
    txns = spark.createDataFrame(rows, schema).withColumn("merchant", counted("merchant"))
    write_synced(txns, str(tmp_path / "synced"))
    assert seen.value == 50
    assert read_synced(spark, str(tmp_path / "synced")).count() == 50
