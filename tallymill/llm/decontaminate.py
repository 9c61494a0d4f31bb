"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words go into one automaton that knows every run of words of every item. A
document is streamed through it; at each word the automaton holds the longest run of words
ending there that some item contains. Where that run has the length of a window, the words
of the window are hit. An item shorter than a window is one window itself.

The automaton is small: items are dealt into blocks of at most about ``BLOCK_WORDS`` words,
stored in the shared folder. A task takes a group of documents through the blocks in turn and
builds each block's automaton itself, holding one at a time. So the memory of a task is bounded
however large the benchmark is, and none of it passes through the driver. Items longer than
``PIECE_WORDS`` are cut into pieces that overlap by a window less one word, which keeps
every window.

Before streaming, a table of the items' word pairs finds the stretches of a document in
which every neighbouring pair occurs in some item; no window lies outside of these.

Defined cases: null and empty texts have no words, an item without words has no windows,
items with equal ids count once, a null id counts as the text ``null``. Repeated documents
are treated alike. Without items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import SLICE_ROWS, map_slices, utf8
from tallymill.session import discard, materialize

WINDOW = 10
BLOCK_WORDS = 1_000_000
PIECE_WORDS = 5_000
#: Documents that go through the blocks together, where there are several.
GROUP_BYTES = 64 << 20
PAIR_BITS = 22

#: Letters in lower case; everything else of ASCII but digits ends a word.
WORD_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte
    if byte >= 128 or 48 <= byte <= 57 or 97 <= byte <= 122
    else 32
    for byte in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """All runs of words of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the runs that end one word after ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: Sequence[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:  # another sequence has this run already
            exact = self.length[target] == self.length[last] + 1
            return target if exact else self._split(last, word, target)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, word, target)
        return new

    def stream(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest known run that ends there."""
        state, length = 0, 0
        edges, link, lengths = self.next, self.link, self.length
        for word in words:
            while word not in edges[state] and state:
                state = link[state]
                length = lengths[state]
            if word in edges[state]:
                state = edges[state][word]
                length += 1
            yield state, length

    def holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a run that ends in ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Matcher:
    """Finds the windows of a block of items in documents."""

    def __init__(self, pieces: Sequence[tuple[str, bool, Sequence[bytes]]], window: int) -> None:
        """pieces: (item, whether it is shorter than a window, words)."""
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [
            (item, short, [self.ids.setdefault(word, len(self.ids) + 1) for word in words])
            for item, short, words in pieces
        ]
        self.runs = SuffixAutomaton()
        pairs = [np.zeros(0, np.uint64)]
        for _, _, words in coded:
            self.runs.add(words)
            pairs.append(self._pairs(np.array(words, np.uint64)))
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[np.concatenate(pairs)] = True
        self.items: dict[tuple[int, int], set[str]] = {}
        for item, short, words in coded:
            size = len(words) if short else window
            for state, length in self.runs.stream(words):
                if length >= size:
                    key = (self.runs.holding(state, size), size)
                    self.items.setdefault(key, set()).add(item)
        self.sizes = sorted({size for _, size in self.items})

    def _pairs(self, words: np.ndarray) -> np.ndarray:
        mixed = (words[:-1] << np.uint64(32) | words[1:]) * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(64 - PAIR_BITS)

    def _stretches(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs [start, end) long enough for a window in which each pair of words is known."""
        least = self.sizes[0]
        known = words > 0
        if least > 1:
            joined = known[:-1] & known[1:]
            joined[joined] = self.pairs[self._pairs(words)[joined]]
            ends = np.flatnonzero(np.concatenate(([True], ~joined, [True])))
            starts, ends = ends[:-1], ends[1:]
            long = ends - starts >= least
        else:
            ends = np.flatnonzero(np.concatenate(([True], ~known, [True])))
            starts, ends = ends[:-1], ends[1:] - 1
            long = ends > starts
        yield from zip(starts[long].tolist(), ends[long].tolist())

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs [start, end) of the document, disjoint and in order, and the items."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.sizes or len(words) < self.sizes[0]:
            return hits, items
        get = self.ids.get
        coded = np.array([get(word, 0) for word in words], np.uint64)
        for start, end in self._stretches(coded):
            for at, (state, length) in enumerate(self.runs.stream(coded[start:end].tolist())):
                for size in self.sizes:
                    if size > length:
                        break
                    found = self.items.get((self.runs.holding(state, size), size))
                    if found:
                        items |= found
                        hits.append((start + at + 1 - size, start + at + 1))
        return merged(hits), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pieces_of(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, short, words): the items' words, long items in overlapping pieces."""
    named = F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item")

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            step = PIECE_WORDS - window + 1
            for name, value in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
                words = words_of(value)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), step):
                    rows.append((name, len(words) < window, words[at : at + PIECE_WORDS]))
            return pa.record_batch(
                [
                    pa.array([row[0] for row in rows], pa.string()),
                    pa.array([row[1] for row in rows], pa.bool_()),
                    pa.array([row[2] for row in rows], pa.list_(pa.binary())),
                ],
                ["item", "short", "words"],
            )

        return work

    source = benchmark.select(named, F.col(text).alias("text"))
    return map_slices(source, "item string, short boolean, words array<binary>", factory)


class Blocks:
    """The stored pieces of the items by block; tasks build a block's automaton from them."""

    def __init__(self, pieces: DataFrame, n_blocks: int, window: int) -> None:
        """pieces(item, short, words, block), a stored table."""
        self.window = window
        self.files: list[list[str]] = [[] for _ in range(n_blocks)]
        for row in pieces.select("block", F.input_file_name().alias("uri")).distinct().collect():
            self.files[row.block].append(row.uri)

    def __len__(self) -> int:
        return len(self.files)

    def matcher(self, block: int) -> Matcher:
        pieces = []
        for uri in sorted(self.files[block]):
            files, path = pyarrow.fs.FileSystem.from_uri(uri)
            with files.open_input_file(path) as source:
                rows = pq.read_table(source)
            rows = rows.filter(pc.equal(rows["block"], block))
            pieces += zip(*(rows[name].to_pylist() for name in ("item", "short", "words")))
        return Matcher(pieces, self.window)


def matchers(
    spark: SparkSession, benchmark: DataFrame, item: str = "item_id", text: str = "text",
    window: int = WINDOW,
) -> Blocks:
    """The items' pieces in the shared folder, dealt into blocks."""
    pieces = materialize(pieces_of(benchmark, item, text, window).dropDuplicates(), "pieces")
    (total,) = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    n_blocks = int(total) // BLOCK_WORDS + 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)).cast("int")
    dealt = pieces.withColumn("block", block).repartition(n_blocks, "block")
    stored = materialize(dealt, "pieces")
    discard(pieces)
    return Blocks(stored, n_blocks, window)


FOUND = "n_words long, runs array<struct<start:long,end:long>>, items array<string>, rest string"


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    carry: Sequence[str] | None = None,
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(row, text, n_words, runs, items, rest) for each document.

    ``row`` is a struct of the carried columns (all by default), ``runs`` the hit runs of
    words as [start, end), ``items`` the items that have a window in the document, ``rest``
    the text without the hit runs, null where nothing is hit.
    """
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns])
    empty = StructType.fromDDL(FOUND)
    found = docs.select(
        carried.alias("row"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(empty["runs"].dataType).alias("runs"),
        F.array().cast(empty["items"].dataType).alias("items"),
        F.lit(None).cast("string").alias("rest"),
    )
    blocks = matchers(docs.sparkSession, benchmark, item, item_text, window)
    return found.select("row", "text").mapInArrow(_marking(blocks), found.schema)


def _groups(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches in groups of about ``n_bytes`` bytes."""
    group, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            group.append(part)
            size += part.nbytes
            if size >= n_bytes:
                yield group
                group, size = [], 0
    if group:
        yield group


def _marking(blocks: Blocks):
    """Each group of documents goes through the blocks in turn; one automaton is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = list(range(len(blocks)))
        # With a single block there is nothing to wait for.
        n_bytes = GROUP_BYTES if len(order) > 1 else 0
        held, matcher = None, None
        for group in _groups(batches, n_bytes):
            found = [[([], set(), 0)] * part.num_rows for part in group]
            for block in order:
                if block != held:
                    matcher = None  # the one before goes first
                    held, matcher = block, blocks.matcher(block)
                for part, own in zip(group, found):
                    for at, value in enumerate(utf8(part.column("text"))):
                        words = words_of(value)
                        runs, items = matcher.find(words)
                        own[at] = (own[at][0] + runs, own[at][1] | items, len(words))
            order.reverse()  # so the last automaton is the next one's first
            for part, own in zip(group, found):
                yield _marked(part, own)

    return run


def _marked(part: pa.RecordBatch, found: list[tuple[list, set[str], int]]) -> pa.RecordBatch:
    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    runs = [merged(own) for own, _, _ in found]
    hit = [at for at, own in enumerate(runs) if own]
    texts = utf8(part.column("text").take(pa.array(hit, pa.int64())))
    rest: list[str | None] = [None] * len(runs)
    for at, text in zip(hit, texts):
        rest[at] = cut(text, runs[at]).decode()
    return pa.record_batch(
        [
            part.column("row"),
            part.column("text"),
            pa.array([n for _, _, n in found], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in own] for own in runs], pa.list_(run)),
            pa.array([sorted(items) for _, items, _ in found], pa.list_(pa.string())),
            pa.array(rest, pa.string()),
        ],
        ["row", "text", "n_words", "runs", "items", "rest"],
    )


def n_hit(runs: str = "runs") -> Column:
    return F.aggregate(
        runs, F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"]
    )


def cut(text: bytes, runs: Sequence[tuple[int, int]]) -> bytes:
    """The text without the runs of words; what stands between removed words goes too."""
    spans = [match.span() for match in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at : spans[start][0]])
        at = spans[end - 1][1]
    return b"".join([*kept, text[at:]])


def removed(found: DataFrame, longest_share: float = 0.5, most_run: int | None = None) -> DataFrame:
    """(row, text) of :func:`hits` without contaminated spans.

    A document of which more than ``longest_share`` of the words is hit, or that has a hit
    run of more than ``most_run`` words, goes as a whole; of others the hit runs go. They were
    cut where they were found: a second Python step here would be a second worker for each
    task, and Spark keeps workers for all that follows.
    """
    share_ok = n_hit() <= longest_share * F.col("n_words")
    keep = share_ok
    if most_run is not None:
        keep &= ~F.exists("runs", lambda run: run["end"] - run["start"] > most_run)
    text = F.when(F.size("runs") > 0, F.col("rest")).otherwise(F.col("text"))
    return found.filter(keep).select("row", text.alias("text"))
