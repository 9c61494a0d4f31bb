import random
import re

import pytest

from tallymill.llm import quality_rules
from tests.llm.conftest import SCHEMA, odd_rows, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), len(lines))


@pytest.mark.parametrize("seed", range(12))
def test_measures_equal_brute_force(seed):
    chance = random.Random(seed)
    parts = ["a", "bb", "é", "世", "#x", "|", " ", "\n", "\t", "\x0b", "\x85", "\x1c", "\xa0"]
    text = "".join(chance.choice(parts) + chance.choice(["", " "]) for _ in range(300))
    assert quality_rules.measure(text.encode()) == brute(text)


def test_overlapping_windows_count_words_once():
    words = [f"w{i}" for i in range(10)]
    text = " ".join(words + ["x"] + words)
    assert quality_rules.measure(text.encode())[4] == 20 == brute(text)[4]


def test_small_hosts_are_drawn_towards_the_others(spark):
    rows = [("good", False)] * 90 + [("good", True)] * 10 + [("bad", True)] * 80
    rows += [("bad", False)] * 20 + [("tiny", True)] + [(None, True)] * 5
    rates = quality_rules.host_rates(spark.createDataFrame(rows, "host string, failed boolean"))
    found = {row["host"]: row["shrunk_rate"] for row in rates.collect()}
    assert set(found) == {"good", "bad", "tiny"}
    assert found["good"] < 0.2 and found["bad"] > 0.7 and found["tiny"] < 1.0


def test_documents_of_a_rejected_host_go(spark):
    good = [(i, prose(i, 40), "en", "good", 1) for i in range(40)]
    bad = [(100 + i, "too short", "en", "bad", 1) for i in range(39)]
    bad.append((200, prose(200, 40), "en", "bad", 1))
    docs = spark.createDataFrame(good + bad, SCHEMA)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == set(range(40))
    judged = {r["row"].doc_id: r for r in quality_rules.judge(docs).collect()}
    assert not judged[200].base_failed and not judged[200].kept


def test_odd_documents(odd, nothing):
    found = quality_rules.judge(odd).collect()
    assert len(found) == len(odd_rows())
    for row in found:
        assert tuple(row[2:8]) == brute(row["row"].text)
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judge(nothing).count() == 0
