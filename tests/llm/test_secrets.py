import random
import re

import pytest
from pyspark.sql import functions as F

from tallymill.llm import secrets
from tests.llm.conftest import SCHEMA, odd_rows, prose, rows_of

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(found))


def random_text(seed):
    chance = random.Random(seed)
    pieces = [
        "password", "PassWd", "token", "api_key", "APIKEY", "secret", '"', "'", " ", "=", ":", "é🎈",
        "AKIA", "AKIAAKIAABCDEFGH12", "abcdef0123456789" * 2, "deadbeef", "x-y/z+1_.=", "long-value-1", "\n",
    ]
    return "".join(chance.choice(pieces) for _ in range(60))


def test_patterns_equal_brute_force(spark):
    texts = [random_text(seed) for seed in range(200)]
    texts += ['token=secret="longvalue123"', "token = token = abcdefgh", "🎈token=12345678", "ſecret=12345678"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    found = docs.select(
        "text", secrets.listed(F.array_sort(secrets.base_spans(F.col("text")))).alias("spans")
    )
    assert sum(bool(brute(t)) for t in texts) > 100
    for row in found.collect():
        assert row.spans == brute(row.text)


@pytest.fixture(scope="module")
def corpus(spark):
    chance = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(chance.choice(letters) for _ in range(n))
    rows = []
    for i in range(300):
        words = ["identifier", "configuration", "getElementById", "user_name_field", "documentation"]
        text = " ".join(chance.choice(words) for _ in range(40))
        if i % 3 == 0:
            text += f" token={key(40)}"
        if i % 5 == 1:
            text += f" stands alone {key(40)} here"
        if i % 5 == 2:
            text += " a_very_long_identifier_name_of_version_2_fields"
        rows.append((i, text, "en", "s", 1))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_models_add_random_strings_and_keep_the_base(corpus):
    rows, docs = corpus
    found = secrets.found_secrets(docs, carry=["doc_id", "text"]).select(
        "row.doc_id", "row.text", secrets.listed(F.col("base")).alias("base"), "added"
    )
    right = 0
    for row in found.collect():
        assert row.base == brute(row.text)
        values = [span.value for span in row.added]
        if row.doc_id % 5 == 1:
            right += len(values) == 1 and values[0] in row.text.split("alone ")[1]
        else:
            assert values == []
        for span in row.added:
            assert row.text[span.start : span.end] == span.value
    assert right >= 57  # of 60


def test_mean_ratio_equals_the_sum_over_pairs(spark):
    ratios = [random.Random(i).uniform(-3, 3) for i in range(len(secrets.ALPHABET) ** 2)]
    values = ["ab", "Zz09+/_=-", "aaaaaaaaaaaa", "x"]
    docs = spark.createDataFrame([(v,) for v in values], "value string")
    found = docs.select("value", secrets.mean_ratio(F.col("value"), ratios).alias("mean")).collect()
    size, at = len(secrets.ALPHABET), secrets.ALPHABET.index
    for row in found:
        pairs = [ratios[at(a) * size + at(b)] for a, b in zip(row.value, row.value[1:])]
        assert row.mean == pytest.approx(sum(pairs) / max(len(row.value) - 1, 1), abs=1e-5)


def test_no_python_in_the_plan(odd):
    plan = secrets.found_secrets(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_documents(odd, nothing):
    found = secrets.found_secrets(odd)
    assert found.count() == len(odd_rows())
    assert set(rows_of(found.select(secrets.listed(F.col("base")).alias("x")), "x")) == {"Row(x='')"}
    assert secrets.found_secrets(nothing).count() == 0
    assert prose(1, 3) != ""


def test_models_count_all_documents(spark, monkeypatch):
    """25,000 documents without a match and one with: its secret and its other words count."""
    rows = [(i, f"identifier number{i:05}", "en", "s", 1) for i in range(25_000)]
    rows += [(30_000, 'surrounding1 token="QqQqQqQq" token=secret=XxXxXxXx zZzZzZzZ', "en", "s", 1)]
    seen = []
    count = secrets._pair_counts
    monkeypatch.setattr(secrets, "_pair_counts", lambda v: seen.append(count(v)) or seen[-1])
    secrets.train(secrets.labelled_strings(spark.createDataFrame(rows, SCHEMA)))
    hidden, ordinary = seen[0]
    assert hidden["Qq"] == 4 and hidden["Xx"] == 4
    assert ordinary["zZ"] == 4 and ordinary["rr"] == 1 and "Qq" not in ordinary
    assert ordinary["mb"] == 25_000


def test_random_strings_of_letters_short_ones_and_ones_in_paths(spark):
    chance = random.Random(4)
    lower = "abcdefghijklmnopqrstuvwxyz"
    letters = lower.upper() + lower
    mixed = letters + "0123456789"
    key = lambda n, of=mixed: "".join(chance.choice(of) for _ in range(n))
    words = ["identifier", "configuration", "getElementById", "documentation", "internationalization"]
    words += ["user_name_field", "characteristically", "https://host/path/download", "non-functional"]
    rows, planted = [], {}
    for i in range(400):
        text = " ".join(chance.choice(words) for _ in range(60)) + f" token={key(40)}"
        if i % 10 < 4:
            one = key((40, 16, 40, 20)[i % 10], letters if i % 10 == 0 else mixed)
            joined = ("{}", "{}", "https://host/documentation/download/{}", "user_name_{}")[i % 10]
            text += " " + joined.format(one)
            planted[i] = one
        rows.append((i, text, "en", "s", 1))
    found = secrets.found_secrets(spark.createDataFrame(rows, SCHEMA), carry=["doc_id", "text"])
    right = [0] * 4
    for row in found.select("row.doc_id", "row.text", "added").collect():
        assert all(row.text[span.start : span.end] == span.value for span in row.added)
        if row.doc_id in planted:
            right[row.doc_id % 10] += any(planted[row.doc_id] in x.value for x in row.added)
            assert len(row.added) <= 1
        else:
            assert row.added == []
    assert min(right) >= 38  # of 40 each


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SHAPES = {"mixed": UPPER + UPPER.lower() + DIGITS, "lower": UPPER.lower(), "upper": UPPER + DIGITS, "letters": UPPER + UPPER.lower()}
ORDINARY = (
    "identifier configuration getElementById documentation internationalization user_name_field "
    "characteristically non-functional responsibilities transformation administration HttpRequestHandler "
    "MAXIMUM_BUFFER_SIZE measurements nevertheless understanding production_environment"
).split()


def planted_corpus(share, n_docs, per_doc):
    """Documents of which a share holds ``per_doc`` keys that fit no pattern, of four shapes."""
    chance = random.Random(8)
    rows, keys = [], {}
    for i in range(n_docs):
        words = [chance.choice(ORDINARY) for _ in range(50)]
        if i % 40 == 1:
            words.append(f"token={''.join(chance.choice(SHAPES['mixed']) for _ in range(40))}")
        if chance.random() < share:
            for n in range(per_doc):
                shape = sorted(SHAPES)[n % len(SHAPES)]
                key = "".join(chance.choice(SHAPES[shape]) for _ in range((20, 24, 32, 40)[n // 4 % 4]))
                keys.setdefault(i, []).append((shape, key))
                words.insert(chance.randrange(len(words)), key)
        rows.append((i, " ".join(words), "en", "s", 1))
    return rows, keys


@pytest.mark.parametrize("share, n_docs, per_doc", [(0.002, 4_000, 16), (0.01, 2_000, 16), (0.1, 1_000, 16), (0.02, 600, 240)])
def test_unlabelled_secrets_do_not_hide_each_other(spark, share, n_docs, per_doc):
    rows, keys = planted_corpus(share, n_docs, per_doc)
    assert keys
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = secrets.found_secrets(docs, carry=["doc_id"]).select("row.doc_id", "added.value").collect()
    values = {row.doc_id: set(row.value) for row in found}
    planted, right = {}, {}
    for i, own in keys.items():
        for shape, key in own:
            planted[shape] = planted.get(shape, 0) + 1
            right[shape] = right.get(shape, 0) + (key in values[i])
    assert all(right[shape] >= 0.9 * planted[shape] for shape in planted), (right, planted)
    assert all(not (own - {key for _, key in keys.get(i, [])}) for i, own in values.items())


def test_labelled_strings_alone_decide(spark):
    chance = random.Random(3)
    key = lambda: "".join(chance.choice(SHAPES["mixed"]) for _ in range(30))
    labelled = [(key(), True) for _ in range(3_000)] + [(word, False) for word in ORDINARY]
    labelled += [(None, True), ("x", None)]
    table = spark.createDataFrame(labelled, "value string, secret boolean")
    one = key()
    docs = spark.createDataFrame([(1, f"measurements {one} nevertheless", "en", "s", 1)], SCHEMA)
    (row,) = secrets.found_secrets(docs, labelled=table).collect()
    assert [span.value for span in row.added] == [one]
    (row,) = secrets.found_secrets(docs, labelled=table.limit(0)).collect()
    assert row.added == []
