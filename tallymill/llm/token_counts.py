"""Token counts of a unigram tokenizer, by dynamic programming that words share in a trie.

A text is cut into words at ASCII white space; each is encoded with a mark before it. The
best segmentation of a word is found by a forward pass: the best score of each prefix is the
best over the pieces that end there. Words with a common prefix share the pass up to there.

The distinct words that are new to a slice of documents make a trie, which is walked depth
first: in the order of the words, from one word's path back to the prefix it shares with the
next. Each node is scored once, from the pieces that begin at its ancestors and are still
open, which a trie of the pieces tells. Only the path walked is held, however many words there
are; the count of a word is stored where it ends.

Scores come from a public vocabulary with ranks: the log probability of a piece is
``-log(rank + 1)``. A character that is no piece is as many tokens as it has UTF-8 bytes, at
a score below all pieces. Of equal scores the one with fewer tokens is taken.

Defined cases: null, empty and blank texts have no tokens. Equal rows are counted alike. A task
remembers up to ``KNOWN_WORDS`` words; beyond that, those of the latest slice. That changes no
count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import map_parts, text_parts, utf8

MARK = "▁"
KNOWN_WORDS = 400_000
#: Longer words are counted but not remembered.
LONGEST_WORD = 64
#: Documents, and about the bytes of text, whose new words make one trie.
SLICE_DOCS, SLICE_BYTES = 2_000, 16_000_000
UNKNOWN_PENALTY = 10.0


def read_pieces(model_file: str) -> dict[str, float]:
    """Log probabilities of the ordinary pieces of a ranked vocabulary file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    found = {}
    for at in range(model.get_piece_size()):
        if not (model.is_unknown(at) or model.is_control(at) or model.is_byte(at)):
            found[model.id_to_piece(at)] = -math.log(1 + max(0.0, -model.get_score(at)))
    return found


class Scorer:
    """Forward scores along paths of a trie of words."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        #: A node of the pieces' trie maps a character to (its node, the score of a piece or None).
        self.root: dict[str, list] = {}
        for piece, score in pieces.items():
            node = self.root
            for character in piece[:-1]:
                node = node.setdefault(character, [{}, None])[0]
            node.setdefault(piece[-1], [{}, None])[1] = score

    def start(self) -> tuple[list, float, int]:
        """The state of the empty prefix: open pieces, score, tokens."""
        return [(self.root, 0.0, 0)], 0.0, 0

    def step(self, state: tuple[list, float, int], character: str) -> tuple[list, float, int]:
        """The state of a prefix with one more character."""
        opened, before, n_before = state
        best, tokens, still = -math.inf, 0, []
        for node, score, count in opened:
            edge = node.get(character)
            if edge is not None:
                child, piece = edge
                if piece is not None:
                    total = score + piece
                    if total > best or (total == best and count < tokens):
                        best, tokens = total, count + 1
                if child:
                    still.append((child, score, count))
        edge = self.root.get(character)
        if edge is None or edge[1] is None:
            total = before + self.unknown
            count = n_before + len(character.encode("utf-8", "surrogatepass"))
            if total > best or (total == best and count < tokens):
                best, tokens = total, count
        still.append((self.root, best, tokens))
        return still, best, tokens

    def counts(self, words: Iterable[str]) -> list[int]:
        """Tokens of words in order; equal beginnings of neighbours are scored once."""
        path, last, found = [self._marked()], "", []
        step = self.step
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            state = path[-1]
            for character in word[shared:]:
                state = step(state, character)
                path.append(state)
            found.append(state[2])
            last = word
        return found

    def _marked(self) -> tuple[list, float, int]:
        state = self.start()
        for character in MARK:
            state = self.step(state, character)
        return state


class WordCounts:
    """Tokens of the words of a task."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.scorer = Scorer(pieces)
        self.known: dict[bytes, int] = {}

    def add(self, wanted: set[bytes]) -> dict[bytes, int]:
        """Tokens of all of ``wanted`` words, and of others."""
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            # What this slice uses stays: mostly the frequent words.
            self.known = {word: self.known[word] for word in wanted.difference(new)}
        texts = sorted(word.decode() for word in new)
        found = self.known
        for text, count in zip(texts, self.scorer.counts(texts)):
            found[text.encode()] = count
        if len(found) <= KNOWN_WORDS and all(len(word) <= LONGEST_WORD for word in new):
            return found
        self.known = {word: n for word, n in found.items() if len(word) <= LONGEST_WORD}
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        return found


def token_counts(
    docs: DataFrame, model_file: str, text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """(row, n_words, n_tokens) for each document."""
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns])
    source = docs.select(carried.alias("row"), F.col(text).alias("text"))
    schema = StructType([source.schema["row"]]).add("n_words", "long").add("n_tokens", "long")

    def factory():
        counts = WordCounts(read_pieces(model_file))

        def counted(part: pa.RecordBatch) -> pa.RecordBatch:
            split = [value.split() if value else [] for value in utf8(part.column("text"))]
            known = counts.add(set().union(*split))
            n_words = pa.array(list(map(len, split)), pa.int64())
            n_tokens = [sum(map(known.__getitem__, words)) for words in split]
            return pa.record_batch([part.column("row"), n_words, pa.array(n_tokens, pa.int64())], schema.names)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            return map(counted, text_parts(batch, SLICE_DOCS, SLICE_BYTES))

        return work

    return map_parts(source, schema, factory)
