import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymill.operators.normalize import CATEGORY_OF_CODE, normalize
from tallymill.plans.feed import sync
from tallymill.schemas import FEED
from tallymill.sources.feed import (
    BROKEN,
    NO_NUMBER,
    feed_rejects,
    payload_rejects,
    read_feed,
    read_payloads,
    records_of,
    rejects_of,
)
from tallymill.sources.snapshots import Snapshots
from tallymill.sources.transactions import read_synced, synced_store
from tallymill.streaming.feed import batch_sync, rejects_store, stream_texts, sync_stream
from workload import queries

# The first two records and what becomes of them.
RECORDS = [
    (12.34, "2024-06-15", "Starbucks", ("FOOD_AND_DRINK",)),
    (-1200.0, "2024-06-20", "Payroll", ("INCOME",)),
    (5.0, "", "", ("food_and_drink",)),
    (-7.5, None, None, ("SHOPPING",)),
    (None, "2024-02-30", "X", None),
    (float("nan"), "2024-01-01", " ", (None,)),
]
EXPECTED = [
    (dt.date(2024, 6, 15), "Starbucks", "Dining", Decimal("12.34")),
    (dt.date(2024, 6, 20), "Payroll", "Income", Decimal("1200.00")),
    (None, "Unknown", "Other", Decimal("5.00")),
    (None, "Unknown", "Income", Decimal("7.50")),
    (None, "X", "Other", Decimal("0.00")),
    (dt.date(2024, 1, 1), " ", "Other", None),
]


def test_normalize(spark):
    feed = spark.createDataFrame(RECORDS, FEED)
    assert [tuple(row) for row in normalize(feed).collect()] == EXPECTED


def test_all_codes(spark):
    codes = [*CATEGORY_OF_CODE, "GENERAL_SERVICES", "travel", None]
    feed = spark.createDataFrame([(1.0, "", str(code), (code,)) for code in codes], FEED)
    found = {row.merchant: row.category for row in normalize(feed).collect()}
    assert found == {str(code): CATEGORY_OF_CODE.get(code, "Other") for code in codes}
    assert len(CATEGORY_OF_CODE) == 10


def test_amounts_as_text(spark):
    amounts = ["13.75", " -2 ", "1e2", "twelve", "", None, "NaN"]
    feed = spark.createDataFrame([(a, "", str(n), None) for n, a in enumerate(amounts)], FEED)
    found = {row.merchant: (row.amount, row.category) for row in normalize(feed).collect()}
    known = {n: v for n, (v, _) in found.items() if v is not None}
    assert known == {"0": Decimal("13.75"), "1": Decimal(2), "2": Decimal(100), "5": Decimal(0)}
    assert found["1"][1] == "Income"


GOOD = '{"amount": "13.75", "date": "2024-01-02", "merchant_name": "A"}'
BAD_AMOUNT = '{"amount": "twelve", "merchant_name": "B"}'
BROKEN_TEXTS = ['{"transactions": [', "no json", "[1]", "7", "null", '{"transactions": 5}']


def test_what_cannot_be_read_is_reported(spark, tmp_path):
    lines = ['{"transactions": [%s, %s]}' % (GOOD, BAD_AMOUNT), "{}", "  ", *BROKEN_TEXTS]
    (tmp_path / "payloads.json").write_text("\n".join(lines))
    path = str(tmp_path / "payloads.json")
    rows = normalize(read_payloads(spark, path)).collect()
    assert [(r.merchant, r.amount) for r in rows] == [("A", Decimal("13.75")), ("B", None)]
    rejects = payload_rejects(spark, path).collect()
    assert sorted(r.text for r in rejects if r.reason == BROKEN) == sorted(BROKEN_TEXTS)
    assert [("twelve" in r.text) for r in rejects if r.reason == NO_NUMBER] == [True]

    (tmp_path / "records.json").write_text("\n".join([GOOD, '{"amount": 1', BAD_AMOUNT, "[]"]))
    path = str(tmp_path / "records.json")
    assert read_feed(spark, path).count() == 2
    assert sorted(r.reason for r in feed_rejects(spark, path).collect()) == sorted([BROKEN, BROKEN, NO_NUMBER])


def test_a_payload_over_many_lines(spark, tmp_path):
    text = '{\n "transactions": [\n  %s,\n  %s\n ]\n}\n' % (GOOD, GOOD)
    (tmp_path / "response.json").write_text(text)
    path = str(tmp_path / "response.json")
    assert read_payloads(spark, path, multi_line=True).count() == 2
    assert payload_rejects(spark, path, multi_line=True).isEmpty()
    assert read_payloads(spark, path).isEmpty()


def test_sync_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "synced")
    feed = spark.createDataFrame(RECORDS, FEED)
    assert sync(feed, path).count() == len(RECORDS)
    second = sync(feed.limit(1), path)
    assert [tuple(row) for row in second.collect()] == EXPECTED[:1]


def test_feed_files_and_payloads(spark, tmp_path):
    one = '{"amount": 1.5, "date": "2024-01-02", "merchant_name": "A", "extra": {"x": 1}}'
    (tmp_path / "records.json").write_text(f"{one}\n{one}\n")
    assert read_feed(spark, str(tmp_path / "records.json")).count() == 2
    lines = ['{"transactions": [%s, %s]}' % (one, one), "{}", '{"transactions": []}']
    (tmp_path / "payloads.json").write_text("\n".join(lines))
    assert read_payloads(spark, str(tmp_path / "payloads.json")).count() == 2
    texts = spark.createDataFrame([(line,) for line in lines], "body string")
    rows = normalize(records_of(texts, F.col("body"))).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 1, 2), "A", "Other", Decimal("1.50"))] * 2


def stored(spark, path):
    return sorted(map(str, read_synced(spark, path).collect()))


def test_the_stream_keeps_the_rules_of_the_batch_feed(spark, tmp_path):
    source, target, rejects = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "rejects")
    source.mkdir()
    lines = ['{"transactions": [%s, %s]}' % (GOOD, BAD_AMOUNT), "{}", "  ", *BROKEN_TEXTS]
    for at, line in enumerate(lines):
        (source / f"{at}.json").write_text(f"{line}\n{lines[0]}\n")
    for _ in range(2):  # the second run finds nothing new
        texts = stream_texts(spark, str(source), files_per_batch=2)
        sync_stream(texts, target, rejects, str(tmp_path / "state")).awaitTermination(300)
        want = normalize(read_payloads(spark, str(source)))
        assert stored(spark, target) == sorted(map(str, want.collect()))
        wrong = sorted(map(str, payload_rejects(spark, str(source)).collect()))
        assert sorted(map(str, rejects_store(spark, rejects).read().collect())) == wrong
    assert len(synced_store(spark, target).current().parts) == (len(lines) + 1) // 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    target, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    run = batch_sync(target, rejects, "source", payloads=False)
    texts = spark.createDataFrame([(GOOD,), (BAD_AMOUNT,), ("[1]",)], "body string")
    run(texts, 0)
    before = stored(spark, target)
    run(texts, 0)
    assert stored(spark, target) == before and len(before) == 2
    # The run ends after the rejects are written; the batch comes again.
    append = Snapshots.append

    def fails(self, df, *more):
        if self.folder == target:
            raise OSError("lost")
        return append(self, df, *more)

    monkeypatch.setattr(Snapshots, "append", fails)
    with pytest.raises(OSError):
        run(texts, 1)
    monkeypatch.setattr(Snapshots, "append", append)
    assert stored(spark, target) == before
    run(texts, 1)
    assert len(stored(spark, target)) == 4
    assert rejects_store(spark, rejects).current().n_rows == 4


def test_a_replacing_stream_holds_the_last_batch(spark, tmp_path):
    target = str(tmp_path / "out")
    run = batch_sync(target, str(tmp_path / "rejects"), "source", payloads=False, replace=True)
    for batch, line in enumerate((GOOD, BAD_AMOUNT)):
        run(spark.createDataFrame([(line,)], "body string"), batch)
    assert [row.merchant for row in read_synced(spark, target).collect()] == ["B"]


def test_texts_are_parsed_once(spark):
    texts = spark.createDataFrame([('{"transactions": [%s]}' % GOOD,)], "body string")
    for rows in (normalize(records_of(texts, F.col("body"))), rejects_of(texts, F.col("body"))):
        # The formatted plan names each step's expressions once.
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1, plan


def test_the_streamed_feed_comes_in_more_files_than_batches(spark, monkeypatch):
    asked = []

    def spied(spark, folder, files_per_batch):
        asked.append((spark.read.text(folder).inputFiles(), files_per_batch))
        return stream_texts(spark, folder, files_per_batch=files_per_batch)

    monkeypatch.setattr(queries, "stream_texts", spied)
    queries.feed_stream(spark, "/root/testdata/sf0.001")
    files, per_batch = asked[0]
    assert len(files) == 3 * per_batch >= int(spark.conf.get("spark.sql.shuffle.partitions"))
