import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tallymill.llm import suffix_index
from tallymill.session import dropping_shuffles, fresh_path
from tests.llm.conftest import SCHEMA, odd_rows, prose


def brute(texts, length=400):
    """(bytes, removed, spans, hash of the rest) of each text, by all strings of ``length``."""
    data = [(text or "").encode() for text in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found_in(spark, texts, **more):
    rows = [(i, text, "en", "s", 1) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = suffix_index.without_repeats(docs, carry=["doc_id"], **more).collect()
    found = sorted(found, key=lambda row: row["row"].doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(3)
    passages = [prose(1000 + i, 60 + 40 * i) for i in range(4)]
    out = []
    for i in range(45):
        text = prose(i, 20 + 5 * i)
        for _ in range(i % 3):
            passage = chance.choice(passages)
            a = chance.randrange(0, 200)
            b = chance.choice([a + 399, a + 400, a + 401, a + 700, len(passage)])
            at = chance.randrange(len(text))
            text = text[:at] + passage[a:b] + text[at:]
        out.append(text)
    out += [out[7], out[7], out[20] + "x", "é" + out[21]]
    out += ["ab" * 300, "z" * 900, prose(5000, 90) * 2, "世界" * 100 + prose(1, 5), "short", "", None]
    return out


def test_removed_bytes_equal_brute_force(spark, texts):
    want = brute(texts)
    assert sum(row[1] > 0 for row in want) > 25
    assert found_in(spark, texts) == want


def test_batches_and_chunks_change_nothing(spark, texts, monkeypatch):
    want = brute(texts)
    assert found_in(spark, texts, batches=1) == want
    monkeypatch.setattr(suffix_index, "CHUNK", 100)
    assert found_in(spark, texts, batches=7) == want


def test_every_window_has_one_suffix_and_equal_windows_the_same_place():
    data = (prose(1, 400) + prose(2, 300) + prose(1, 400)).encode()
    at, low, high = suffix_index.sampled(data)
    place = {}
    for a, b, c in zip(at.tolist(), low.tolist(), high.tolist()):
        for offset in range(b, c + 1):
            assert place.setdefault(a - offset, offset) == offset
            assert 0 <= offset <= suffix_index.LENGTH - suffix_index.CORE
    assert sorted(place) == list(range(len(data) - suffix_index.LENGTH + 1))
    by_window = {}
    for start, offset in place.items():
        assert by_window.setdefault(data[start : start + suffix_index.LENGTH], offset) == offset


def test_runs_merge_geometrically(spark):
    entry = "core long, hull long, key_a long, key_b long, at long, low int, high int"
    index, sizes = suffix_index.SuffixIndex(), []
    for batch in range(6):
        rows = [(core, batch, batch, 0, core, 0, 0) for core in range(batch, batch + 3)]
        index.add(spark.createDataFrame(rows, entry))
        sizes.append([size for size, _ in index.runs])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    found = {row.core for row in index.repeated().collect()}
    assert found == {1, 2, 3, 4, 5, 6}
    for _, run in index.runs:
        cores = [row.core for row in run.orderBy("core").collect()]
        assert cores == sorted(cores)
    index.drop()


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 50):
        want = [values[i : i + width].min() for i in range(50 - width + 1)]
        assert suffix_index.sliding_least(values, width).tolist() == want


def test_kept_bytes_are_those_of_the_hash(spark):
    base = prose(1, 200)
    docs = spark.createDataFrame([(1, "a" + base, "en", "s", 1), (2, "b" + base, "en", "s", 1)], SCHEMA)
    for row in suffix_index.without_repeats(docs).collect():
        assert bytes(row.kept) == (b"a" if row["row"].doc_id == 1 else b"b")
        assert hashlib.sha256(bytes(row.kept)).hexdigest() == row.kept_sha256


def test_odd_documents(odd, nothing):
    found = suffix_index.without_repeats(odd).collect()
    want = brute([row[1] for row in odd_rows()])
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert sorted(got) == sorted(want)
    assert suffix_index.without_repeats(nothing).count() == 0


def test_tables_and_shuffles_go_as_soon_as_the_next_table_is_stored(spark, texts):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder = Path(fresh_path(spark, "any").replace("file://", "").removeprefix("file:")).parent
    stored = lambda: set(folder.iterdir()) if folder.exists() else set()
    before, setting = stored(), spark.conf.get(name)
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string")
    found = suffix_index.without_repeats(docs, carry=["doc_id"])
    left = sorted(path.name.rpartition("-")[0] for path in stored() - before)
    assert left == ["measured", "spans"]
    assert spark.conf.get(name) == setting
    assert found.filter("n_removed > 0").count() > 0
    with dropping_shuffles(spark):
        assert spark.conf.get(name) == "true"
