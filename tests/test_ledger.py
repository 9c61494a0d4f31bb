import datetime as dt

from test_matching import asked, frame, make_rows
from tallymill.functions.keywords import KNOWN_MERCHANTS
from tallymill.operators.ranges import day_cells
from tallymill.plans import ledger as ledgers
from tallymill.plans.answers import AnswerBook
from tallymill.plans.ledger import Ledger
from tallymill.plans.ranges import open_ranges


def told(book):
    tables = (book.summaries(), book.category_breakdown(), book.top_merchants(), book.answers())
    return [sorted(map(str, table.select(*sorted(table.columns)).collect())) for table in tables]


def test_batches_give_the_totals_of_one(spark, tmp_path):
    rows = make_rows(1)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for batch in range(5):
        ledger.add(frame(spark, rows[batch::5]), "bank", batch, most_parts=3)
    ledger.add(frame(spark, rows[0::5]), "bank", 0)  # comes again
    assert len(ledger.store.current().parts) <= 3
    whole = AnswerBook.open(asked(spark), frame(spark, rows), KNOWN_MERCHANTS)
    assert told(ledger.book(asked(spark))) == told(whole)
    assert sum(row.rows for row in ledger.cells().collect()) == len(rows)


def test_windows_follow_the_newest_date(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = sorted((r for r in make_rows(2) if r["date"]), key=lambda r: r["date"])
    half = len(rows) // 2
    for batch, some in enumerate((rows[:half], rows[half:])):
        ledger.add(frame(spark, some), "bank", batch)
        so_far = rows[: half * (batch + 1)] if batch == 0 else rows
        assert ledger.newest() == so_far[-1]["date"]
        whole = AnswerBook.open(asked(spark), frame(spark, so_far), KNOWN_MERCHANTS)
        assert told(ledger.book(asked(spark)))[0] == told(whole)[0]


def test_old_transactions_are_not_read_again(spark, tmp_path, monkeypatch):
    """The files of the first batch are gone when the second comes."""
    rows, ledger = make_rows(1), Ledger(spark, str(tmp_path / "ledger"))
    files = tmp_path / "first"
    frame(spark, rows[:150]).write.parquet(str(files))
    ledger.add(spark.read.parquet(str(files)), "bank", 0)
    for file in files.iterdir():
        file.unlink()
    seen = []
    monkeypatch.setattr(ledgers, "day_cells", lambda df, *more: seen.append(df) or day_cells(df, *more))
    second = frame(spark, rows[150:])
    ledger.add(second, "bank", 1)
    assert seen == [second]
    whole = AnswerBook.open(asked(spark), frame(spark, rows), KNOWN_MERCHANTS)
    assert told(ledger.book(asked(spark))) == told(whole)


def test_ranges_of_a_ledger(spark, tmp_path):
    rows, ledger = make_rows(4), Ledger(spark, str(tmp_path / "ledger"))
    for batch in range(2):
        ledger.add(frame(spark, rows[batch::2]), "bank", batch)
    days = "question_id long, query string, first_day date, last_day date"
    table = spark.createDataFrame(
        [(1, "dining or starbucks", dt.date(2023, 1, 1), None), (2, "", None, None), (3, "none", None, dt.date(2024, 3, 1))],
        days,
    )
    assert told(ledger.range_book(table)) == told(open_ranges(table, frame(spark, rows)))


def test_empty_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add(frame(spark, []), "bank", 0)
    assert ledger.newest() is None
    assert all(row.transaction_count == 0 for row in ledger.book(asked(spark)).summaries().collect())

