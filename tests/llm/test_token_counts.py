import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from tallymill.llm import token_counts
from tests.llm.conftest import SCHEMA, odd_rows, prose

FILE = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, pieces):
    """The best segmentation by recursion over all first pieces."""
    unknown = min(pieces.values()) - token_counts.UNKNOWN_PENALTY
    known = {}

    def best(rest):
        if not rest:
            return (0.0, 0)
        if rest not in known:
            options = []
            for n in range(1, len(rest) + 1):
                if rest[:n] in pieces:
                    score, tokens = best(rest[n:])
                    options.append((pieces[rest[:n]] + score, tokens - 1))
            if rest[0] not in pieces:
                score, tokens = best(rest[1:])
                options.append((unknown + score, tokens - len(rest[0].encode())))
            known[rest] = max(options, key=lambda o: (round(o[0], 9), o[1]))
        return known[rest]

    return -best(token_counts.MARK + word)[1]


@pytest.fixture(scope="module")
def pieces():
    return token_counts.read_pieces(FILE)


WORDS = ["hello", "internationalization", "w12x", "naïve", "世界", "🎈", "aaaaaaaa", "don't", "<s>", "▁▁"]


def counted(counts, words):
    known = counts.add({word.encode() for word in words})
    return [known[word.encode()] for word in words]


def test_counts_equal_brute_force(pieces):
    chance = random.Random(1)
    words = WORDS + ["".join(chance.choice("etaoinshr") for _ in range(1 + i % 14)) for i in range(300)]
    want = [brute(word, pieces) for word in words]
    assert counted(token_counts.WordCounts(pieces), words) == want
    # Any order gives the same counts; the sorted one shares most.
    assert token_counts.Scorer(pieces).counts(words) == want


def test_counts_equal_a_public_unigram_library(pieces):
    vocabulary = [("<unk>", -100.0), *pieces.items()]
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, False))
    scorer = token_counts.Scorer(pieces)
    words = sorted({w for i in range(5) for w in prose(i, 200).split()})
    words += ["hello", "internationalization", "tokenizer", "understanding"]
    for word in words:
        ids = tokenizer.encode(token_counts.MARK + word).ids
        state = scorer.start()
        for character in token_counts.MARK + word:
            state = scorer.step(state, character)
        assert state[1] == pytest.approx(sum(vocabulary[i][1] for i in ids), abs=1e-6)
        assert state[2] <= len(ids)


def test_prefixes_are_scored_once(pieces, monkeypatch):
    scorer, seen = token_counts.Scorer(pieces), []
    step = scorer.step
    monkeypatch.setattr(scorer, "step", lambda state, c: seen.append(c) or step(state, c))
    scorer.counts(["token", "tokenizer", "tokens"])
    assert "".join(seen) == "▁tokenizers"


def test_long_words_and_little_memory(pieces, monkeypatch):
    words = ["abc" * 40, "internationalization" * 9, "世" * 90]
    counts = token_counts.WordCounts(pieces)
    assert counted(counts, words) == [brute(w, pieces) for w in words]
    assert not counts.known
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 3)
    small = token_counts.WordCounts(pieces)
    for some in (WORDS[:2], WORDS[1:4], WORDS, WORDS[3:]):
        assert counted(small, some) == [brute(w, pieces) for w in some]
        assert len(small.known) <= 3


def test_documents(spark, odd, nothing, pieces, monkeypatch):
    rows = [(i, prose(i, i), "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for docs_of_slice, bytes_of_slice in ((2_000, 16_000_000), (3, 16_000_000), (2_000, 500)):
        monkeypatch.setattr(token_counts, "SLICE_DOCS", docs_of_slice)
        monkeypatch.setattr(token_counts, "SLICE_BYTES", bytes_of_slice)
        found = token_counts.token_counts(docs, FILE, carry=["text"]).collect()
        for row in found:
            words = row["row"].text.split()
            assert (row.n_words, row.n_tokens) == (len(words), sum(brute(w, pieces) for w in words))
    assert token_counts.token_counts(odd, FILE).count() == len(odd_rows())
    assert token_counts.token_counts(nothing, FILE).count() == 0
