import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

from tallymill.llm import token_files
from tallymill.session import fresh_path
from tests.llm.conftest import SCHEMA, odd_rows, prose

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World! it's 12345 they'll",
    "á b c <|endoftext|>x <|startoftext|> y",
    "\x1cweird\x85space\x1f ΑΣ Σ ΣΑΣ 'tis 's",
    "tab\tnew\nline\x0bvt\x0cff\rcr",
    "x" * 200 + " " + "ab1" * 90,
    "plain words, with (signs) and-more; x=y a.b.c. Été ÑANDÚ straße --",
    "İstanbul ﬁ ½ 世界 🎈🎈 ée ́ lone",
    "",
]


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_parts_give_the_ids_of_the_whole_text():
    encoder, tokenizer = token_files.PartEncoder(FILE), Tokenizer.from_file(FILE)
    for texts in ([*TEXTS, prose(1, 500)], TEXTS, ["", None], []):
        found = encoder.encode_all([None if t is None else t.encode() for t in texts])
        ids = [np.frombuffer(x, "<u4").tolist() for x in found]
        assert ids == [whole(tokenizer, text)[:-1] for text in texts]


def test_random_texts_give_the_ids_of_the_whole_text():
    encoder, tokenizer = token_files.PartEncoder(FILE), Tokenizer.from_file(FILE)
    chance = random.Random(4)
    letters = "abcXYZéÜßñ÷×İŁ'.,!-<>|_&;12 \t\n\u0301\u00a0ﬁ世"
    texts = ["".join(chance.choice(letters) for _ in range(200)) for _ in range(300)]
    found = encoder.encode_all([text.encode() for text in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole(tokenizer, t)[:-1] for t in texts]


def test_random_simple_texts_give_the_ids_of_the_whole_text():
    encoder, tokenizer = token_files.PartEncoder(FILE), Tokenizer.from_file(FILE)
    chance = random.Random(5)
    alphabets = ["abestrvmldß 'É", "aB1 2.,'sé-", "a1'\x00\x1c\x7f \t\n.<|", "aé×÷.,1 '"]
    texts = ["".join(chance.choice(letters) for _ in range(200)) for letters in alphabets * 60]
    found = encoder.encode_all([text.encode() for text in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole(tokenizer, t)[:-1] for t in texts]


def test_simple_texts_are_cut_between_letters_digits_and_signs():
    texts = ["Été, they'll (pay) $12.5!", None, "a×b,c", "x=1", "世,a"]
    found = token_files.cut_apart([None if t is None else t.encode() for t in texts])
    parts = [(text or "").split() for text in found.to_pylist()]
    assert parts[0] == ["été", ",", "they'll", "(", "pay", ")", "$", "1", "2", ".", "5", "!"]
    assert parts[1:] == [[], ["a×b,c"], ["x", "=", "1"], ["世,a"]]


def test_few_documents_go_to_python_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        token_files.token_table(spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA), FILE)
        assert int(spark.conf.get(name)) <= token_files.SLICE_DOCS
    finally:
        spark.conf.set(name, before)


def test_runs_of_parts():
    assert token_files.word_runs("ab ,, a.b.c é! x".encode()).tolist() == [1, 1, 5, 2, 1]


def test_forgetting_parts_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PARTS", 5)
    test_parts_give_the_ids_of_the_whole_text()


def check(docs, rows):
    tokenizer, at, want = Tokenizer.from_file(FILE), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(tokenizer, text)
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = [tuple(row) for row in token_files.token_table(docs, FILE).collect()]
    return sorted(map(str, found)), sorted(map(str, want))


def test_places_and_sums_are_those_of_the_whole(spark):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)] + prose(i, i), "en", "s", 1) for i in range(101)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, want = check(docs, [row[:2] for row in rows])
    assert found == want


def test_files_have_the_stated_format(spark, tmp_path):
    rows = [(i, prose(i, 50), "en", "s", 1) for i in range(300)]
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(spark.createDataFrame(rows, SCHEMA), path, FILE)
    last = -1
    for file in sorted((tmp_path / "tokens").glob("*.parquet")):
        parquet = pq.ParquetFile(file)
        keys = parquet.read(["doc_id"])["doc_id"].to_pylist()
        assert keys == sorted(keys) and (not keys or keys[0] > last)
        last = keys[-1] if keys else last
        for at in range(parquet.metadata.num_row_groups):
            group = parquet.metadata.row_group(at)
            by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            ids = next(c for name, c in by_name.items() if name.startswith("ids"))
            assert any("DICTIONARY" in x for x in ids.encodings)
            assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
            assert by_name["doc_id"].has_column_index and ids.has_offset_index


def test_metadata_is_read_without_ids(spark):
    path = fresh_path(spark, "tokens")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA)
    token_files.write_tokens(docs, path, FILE)
    plan = token_files.token_places(spark, path, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "array<int>" not in plan


def test_odd_documents(odd, nothing):
    found, want = check(odd, [row[:2] for row in odd_rows()])
    # Rows of equal ids may stand in another order than here.
    rest = [str(row) for row in found]
    assert len(rest) == len(want)
    last = lambda rows: sorted(row.split(", ", 2)[2] for row in rows)
    assert last(found) == last(want)
    assert token_files.token_table(nothing, FILE).count() == 0
