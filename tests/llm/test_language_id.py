import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import language_id
from tests.llm.conftest import SCHEMA, odd_rows

WORDS = {
    "aa": "the and that with from this have they were been".split(),
    "bb": "der die und nicht mit sich auf für eine auch".split(),
    "cc": "les des une dans pour qui sur été être avec".split(),
}


def text_of(lang, seed, n):
    chance = random.Random(seed)
    return " ".join(chance.choice(WORDS[lang]) + chance.choice(["", "s", "en"]) for _ in range(n))


def rows(n=120):
    return [
        (i, text_of(lang := "abc"[i % 3] * 2, i, 5 + i % 30), lang, "s", 1) for i in range(n)
    ]


def strings_of(text):
    kept = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    kept = " ".join(kept.split())
    padded = "   " + kept + " "
    return [padded[i - 3 : i + 1] for i in range(3, len(padded))] if kept else []


class BruteModel:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts, n_characters):
        table = Counter(s for text in texts for s in strings_of(text))
        self.orders = {4: table}
        for length in (3, 2, 1):
            self.orders[length] = Counter(s[1:] for s in self.orders[length + 1])
        self.n_characters = n_characters

    def chance(self, string):
        if not string:
            return 1 / (self.n_characters + 1)
        table = self.orders[len(string)]
        own = {s: n for s, n in table.items() if s[:-1] == string[:-1]}
        lower = self.chance(string[1:])
        if not own:
            return lower
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        total = sum(own.values())
        return (max(own.get(string, 0) - discount, 0) + discount * len(own) * lower) / total


def test_scores_equal_brute_force(spark):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    models = language_id.train(docs, "text", "lang")
    by_lang = {x: [r[1] for r in rows(60) if r[2] == x] for x in WORDS}
    characters = {c for r in rows(60) for s in strings_of(r[1]) for c in s[-1]}
    brute = {x: BruteModel(texts, len(characters)) for x, texts in by_lang.items()}
    texts = [text_of("aa", 999, 6), "Zebra, quux!", "été für", "x"]
    for row, n, found in models.entropies(texts):
        strings = strings_of(texts[row])
        assert n == len(strings)
        for at, name in enumerate(models.languages):
            want = -sum(math.log(brute[name].chance(s)) for s in strings) / n
            assert found[at] == pytest.approx(want, rel=1e-4)


def test_chances_sum_to_one(spark):
    models = language_id.train(spark.createDataFrame(rows(60), SCHEMA), "text", "lang")
    single = models.model.lower.lower.lower.keys
    for context in ("the", "zzz", " un", "ch "):
        start = 0
        for c in context:
            start = start << 16 | ord(c)
        wanted = np.array([start << 16 | int(c) for c in single], np.uint64)
        total = np.exp(models.model.scores(wanted).astype(float)).sum(axis=0)
        assert np.all(total < 1.0001) and np.all(total > 0.9)


def test_held_out_texts_are_recognised(spark):
    docs = spark.createDataFrame(rows(300), SCHEMA)
    found = language_id.identify(docs, F.col("doc_id") % 3 != 5).collect()
    assert all(row.lang_pred == row["row"].lang for row in found)
    assert all(0 <= row.score <= 1 for row in found)
    strange = spark.createDataFrame([(1, "ΑΒΓ δεζ ηθι " * 20, None, "s", 1)], SCHEMA)
    both = docs.unionByName(strange)
    marked = language_id.identify(both, F.col("lang").isNotNull()).filter("rejected").collect()
    assert [row["row"].text for row in marked if row["row"].lang is None]
    assert len(marked) < 10


def test_only_training_rows_are_learned(spark):
    docs = spark.createDataFrame(rows(90), SCHEMA)
    found = language_id.identify(docs, F.col("lang") != "cc").collect()
    assert {row.lang_pred for row in found} == {"aa", "bb"}


def test_odd_documents(odd, nothing):
    found = language_id.identify(odd, F.lit(True)).collect()
    assert len(found) == len(odd_rows())
    for row in found:
        letters = any(c.isalpha() for c in row["row"].text or "")
        assert (row.lang_pred == "und") == (not letters)
        assert letters or row.score == 0
    none = language_id.identify(odd, F.lit(False)).collect()
    assert {row.lang_pred for row in none} == {"und"}
    assert language_id.identify(nothing, F.lit(True)).count() == 0


def test_no_string_is_left_out(spark):
    """A language with more than a fortieth of 1,000,000 strings, among forty languages."""
    langs = [f"l{i:02}" for i in range(40)]
    letters = [chr(0x4E00 + i) for i in range(20_000)]
    docs = [
        (i, " ".join(a + letters[i] for a in letters[i : i + 52]), langs[0], "s", 1)
        for i in range(0, 20_000, 52)
    ]
    docs += [(20_000 + i, f"other {chr(97 + i % 26)}", lang, "s", 1) for i, lang in enumerate(langs)]
    table = spark.createDataFrame(docs, SCHEMA)
    counts = language_id.string_counts(table, "text", "lang").collect()
    assert sum(row.lang == "l00" for row in counts) > 1_000_000 // 40
    models = language_id.train(table, "text", "lang")
    strings = np.array([row.string for row in counts], np.int64).view(np.uint64)
    assert set(models.model.keys.tolist()) == set(strings.tolist())


def test_files_of_the_model_hold_all_of_it(spark, monkeypatch):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    whole = language_id.train(docs, "text", "lang")
    monkeypatch.setattr(language_id, "FILE_ROWS", 100)
    monkeypatch.setattr(language_id, "KEPT_ROWS", 250)
    monkeypatch.setattr(language_id, "CELLS", 60)
    cut = language_id.train(docs, "text", "lang")
    assert len({uri for part in cut.model.store.files.values() for *_, uri in part}) > 5
    texts = [text_of("aa", 999, 50), "Zebra, quux!", "가나다 été für 힣"]
    both = zip(whole.entropies(texts), cut.entropies(texts))
    for (row, n, found), (other, m, again) in both:
        assert (row, n) == (other, m) and found == pytest.approx(again)


def test_a_rare_language_has_a_limit_of_its_own(spark):
    docs = [(i, text_of("aa", i, 4), "aa", "s", 1) for i in range(20_000)]
    docs += [(30_000 + i, text_of("bb", i, 30), "bb", "s", 1) for i in range(2)]
    learned = spark.createDataFrame(docs, SCHEMA)
    strange = spark.createDataFrame([(1, "der αβγ nicht δεζ auch ηθι " * 20, None, "s", 1)], SCHEMA)
    found = language_id.identify(learned.unionByName(strange), F.col("lang").isNotNull())
    (row,) = found.filter(F.col("row.lang").isNull()).collect()
    assert row.lang_pred == "bb" and row.rejected
    assert found.filter("row.lang = 'bb' AND rejected").count() == 0


def test_limits_equal_brute_force_over_all_texts(spark):
    docs = spark.createDataFrame(rows(6_000), SCHEMA)
    models = language_id.train(docs, "text", "lang")
    values = {name: [] for name in models.languages}
    table = rows(6_000)
    for row, _, found in models.entropies([r[1] for r in table]):
        values[table[row][2]].append(found[models.languages.index(table[row][2])])
    limits = language_id.rejection_limits(models, docs, "text", "lang")
    for name, limit in zip(models.languages, limits):
        beyond = np.array(values[name]) >= limit
        below = np.array(values[name]) >= limit - language_id.CELL
        assert beyond.mean() <= language_id.REJECTED_SHARE < below.mean()


def test_folds_leave_their_own_texts_out(spark):
    table = rows(90)
    docs = spark.createDataFrame(table, SCHEMA)
    fold = F.pmod(F.xxhash64("text"), F.lit(language_id.FOLDS)).alias("fold")
    fold_of = {row.doc_id: row.fold for row in docs.select("doc_id", fold).collect()}
    whole, folds = language_id.train_folds(docs, "text", "lang")
    for fold, models in enumerate(folds):
        kept = [r for r in table if fold_of[r[0]] != fold]
        alone = language_id.train(spark.createDataFrame(kept, SCHEMA), "text", "lang")
        assert models.model.keys.tolist() == alone.model.keys.tolist()
        assert 0 < len(models.model.keys) <= len(whole.model.keys)


def test_held_out_texts_are_rejected_as_often_as_stated(spark, monkeypatch):
    """Texts of rare words: a model knows its own ones far better than others."""
    monkeypatch.setattr(language_id, "REJECTED_SHARE", 0.02)
    chance = random.Random(11)
    letters = {"aa": "abcdefghij", "bb": "klmnopqrst"}

    def text(lang):
        words = ["".join(chance.choice(letters[lang]) for _ in range(1 + chance.randrange(6))) for _ in range(6)]
        return " ".join(words)

    table = [(i, text(lang := ("aa", "bb")[i % 2]), lang, "s", 1) for i in range(9_000)]
    docs = spark.createDataFrame(table, SCHEMA)
    found = language_id.identify(docs, F.col("doc_id") % 3 != 1)
    held, own = [
        found.filter((F.col("row.doc_id") % 3 == 1) == out).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
        for out in (True, False)
    ]
    assert 0.01 <= held <= 0.04
    learned = docs.filter("doc_id % 3 != 1")
    models, folds = language_id.train_folds(learned, "text", "lang")
    naive = language_id.rejection_limits(models, learned, "text", "lang")
    assert (language_id.rejection_limits(models, learned, "text", "lang", folds) > naive).all()
    assert own <= held
