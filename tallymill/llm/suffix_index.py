"""Remove byte strings that occur twice, by fingerprints of sampled suffixes.

The documents come in ``BATCHES`` batches. The suffixes of each are stored as a run; runs of
equal size merge. This is not a family of suffix arrays with a merge scan: equal fingerprints
are grouped and joined, within a batch and with the runs there are, and no step reads the
runs' order or compares neighbouring suffixes.

A run holds sampled suffixes. With all of them it would be eight times as large as the text.
The sample is chosen by content: of the 64-byte strings inside every window of 400 bytes,
the one with the least hash starts a sampled suffix. Equal windows sample the same place,
so no match of 400 bytes is lost, and about one suffix in 170 is stored. Suffixes are named
by fingerprints of their heads (64 bytes, the ``core``) and of their surroundings.

A sampled suffix stands for the windows that chose it, a range of offsets. Windows are
settled from coarse to fine, each time by counting equal fingerprints:

1. cores that occur once: none of the windows occurs elsewhere;
2. the hull (all bytes of the windows) occurs again: all of them do;
3. else the range is cut into cells of 16 offsets, and these into single windows.

Of suffixes with equal hulls one goes on as a witness for the others. So what goes on is
counted in distinct texts, and every step is an aggregate and a join of narrow rows: no
group of equal strings is ever in one task.

Defined cases: a null or empty text has no bytes and removes nothing; texts of less than 400
bytes neither. Equal rows are copies of each other. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import map_slices, row_key, utf8
from tallymill.session import discard, dropping_shuffles, materialize

LENGTH = 400
CORE = 64
WINDOW = LENGTH - CORE + 1
CELL = 16
BATCHES = 4
#: Windows of a document that are looked at together.
CHUNK = 1 << 20
PLACE_BITS = 24

_FACTOR = 0x9E3779B97F4A7C15
_SIZE = CHUNK + LENGTH
POWERS = np.cumprod(np.full(_SIZE, _FACTOR, np.uint64))
INVERSES = np.cumprod(np.full(_SIZE, pow(_FACTOR, -1, 1 << 64), np.uint64))
LOW = np.uint64((1 << PLACE_BITS) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    least, covered = values, 1
    while 2 * covered <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def sampled(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, low, high): sampled suffixes, and for each the offsets of the windows it stands for.

    A window that starts at s has offset at - s. Each window has exactly one suffix.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_windows = len(data) - LENGTH + 1
    for start in range(0, n_windows, CHUNK):
        n = min(CHUNK, n_windows - start)
        part = np.frombuffer(data, np.uint8, n + LENGTH - 1, start).astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * POWERS[: len(part)], out=sums[1:])
        hashes = (sums[CORE:] - sums[:-CORE]) * INVERSES[: len(part) - CORE + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes &= ~LOW
        hashes |= np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_least(hashes, WINDOW) & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        at = at[first]
        found.append((at + start, at - last, at - first))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(column) for column in zip(*found))


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def hull_seed(low: int, high: int) -> int:
    return low * 1_024 + high


SUFFIX = pa.struct(
    [
        ("core", pa.int64()),
        ("hull", pa.int64()),
        ("at", pa.int64()),
        ("low", pa.int32()),
        ("high", pa.int32()),
    ]
)


def with_suffixes(docs: DataFrame, text: str, carry: Sequence[str]) -> DataFrame:
    """(row, key_a, key_b, n_bytes, sha256, suffixes) for each document."""
    carried = F.struct(*[F.col(f"`{name}`") for name in carry])
    source = docs.select(carried.alias("row"), *row_key(docs), F.col(text).alias("text"))
    names = ["row", "key_a", "key_b"]
    more = StructType.fromDDL(
        "n_bytes long, sha256 string, "
        "suffixes array<struct<core:long,hull:long,at:long,low:int,high:int>>"
    )
    schema = StructType([*[source.schema[name] for name in names], *more.fields])

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, sums, counts = [], [], [0]
            cores, hulls, places = [], [], []
            for value in utf8(batch.column("text")):
                data = value or b""
                at, low, high = sampled(data)
                sizes.append(len(data))
                sums.append(hashlib.sha256(data).hexdigest())
                counts.append(len(at))
                places.append((at, low, high))
                for a, b, c in zip(at.tolist(), low.tolist(), high.tolist()):
                    cores.append(xxhash.xxh3_64_intdigest(data[a : a + CORE]))
                    hull = data[a - c : a - b + LENGTH]
                    hulls.append(xxhash.xxh3_64_intdigest(hull, hull_seed(b, c)))
            columns = [np.concatenate([place[i] for place in places]) for i in range(3)]
            arrays = [
                pa.array(signed(cores)),
                pa.array(signed(hulls)),
                pa.array(columns[0]),
                pa.array(columns[1].astype(np.int32)),
                pa.array(columns[2].astype(np.int32)),
            ]
            flat = pa.StructArray.from_arrays(arrays, fields=list(SUFFIX))
            offsets = pa.array(np.cumsum(counts), pa.int32())
            return pa.record_batch(
                [
                    *[batch.column(name) for name in names],
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.string()),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                schema.names,
            )

        return work

    return map_slices(source, schema, factory)


class SuffixIndex:
    """Stored runs of suffixes(core, hull, at, low, high, ..), of sizes that double."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, DataFrame]] = []
        self.scans: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """Group a batch and join it with all runs by core, then merge runs of equal size."""
        cores = suffixes.groupBy("core").agg(F.count("*").alias("n"))
        found = cores.filter("n > 1").select("core")
        for _, run in self.runs:
            known = run.select("core").distinct()
            found = found.unionByName(cores.join(known, "core", "left_semi").select("core"))
        self.scans.append(materialize(found.distinct(), "scan"))
        size, merged, old = 1, suffixes, []
        while self.runs and self.runs[-1][0] == size:
            _, run = self.runs.pop()
            merged, size = merged.unionByName(run), 2 * size
            old.append(run)
        order = ["core", "hull"]
        ordered = merged.repartitionByRange(*order).sortWithinPartitions(*order)
        self.runs.append((size, materialize(ordered, "run")))
        for run in old:
            discard(run)

    def repeated(self) -> DataFrame:
        """The suffixes of all batches whose core occurs twice or more."""
        cores = self.scans[0]
        for scan in self.scans[1:]:
            cores = cores.unionByName(scan)
        everything = self.runs[0][1]
        for _, run in self.runs[1:]:
            everything = everything.unionByName(run)
        # Stored, so that Spark can split the entries of a core that is very frequent.
        self.scans.append(materialize(cores.distinct(), "cores"))
        return everything.join(self.scans[-1], "core", "left_semi")

    def drop(self) -> None:
        discard_each([*[run for _, run in self.runs], *self.scans])


PLACE = ("key_a", "key_b", "at", "low", "high")


def discard_each(tables: Sequence[DataFrame]) -> None:
    for stored in tables:
        discard(stored)


def settle(nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(settled, open, stored) of nodes(core, hull, open, place columns).

    ``settled``: nodes still open whose hull occurs again. ``open``: one node of each hull
    of cores that occur with several hulls; its ``open`` says whether the hull is single.
    ``stored``: tables that ``open`` reads, to discard after it. ``settled`` is stored itself;
    the nodes, a stored table, are discarded.
    """
    classes = materialize(
        nodes.groupBy("core", "hull").agg(
            F.count("*").alias("n"), F.min(F.struct(*PLACE, "open")).alias("node")
        ),
        "classes",
    )
    again = classes.filter("n > 1").select("core", "hull")
    settled = nodes.filter("open").join(again, ["core", "hull"], "left_semi").select(*PLACE)
    settled = materialize(settled, "settled")
    discard(nodes)
    several = classes.groupBy("core").agg(F.count("*").alias("hulls")).filter("hulls > 1")
    # Stored, so that Spark can split the hulls of a core that is very frequent.
    several = materialize(several.select("core"), "several")
    further = classes.join(several, "core", "left_semi").select(
        *[F.col(f"node.{name}").alias(name) for name in PLACE],
        (F.col("node.open") & (F.col("n") == 1)).alias("open"),
    )
    return settled, further, [classes, several]


def contexts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with ``hull_bytes``: the bytes of all windows of each."""
    spots = nodes.groupBy("key_a", "key_b").agg(
        F.collect_list(F.struct("at", "low", "high", "open")).alias("spots")
    )
    # Copies of a row have equal hulls; as witnesses one of them is enough.
    joined = texts.join(spots, ["key_a", "key_b"])
    schema = StructType.fromDDL(
        "key_a long, key_b long, at long, low int, high int, open boolean, hull_bytes binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("key_a").to_pylist(), batch.column("key_b").to_pylist())
            spots = batch.column("spots")
            for key, data, own in zip(keys, utf8(batch.column("text")), spots):
                rows = own.as_py()
                at = [row["at"] for row in rows]
                low, high = [row["low"] for row in rows], [row["high"] for row in rows]
                hulls = [data[a - c : a - b + LENGTH] for a, b, c in zip(at, low, high)]
                yield pa.record_batch(
                    [
                        pa.array([key[0]] * len(rows), pa.int64()),
                        pa.array([key[1]] * len(rows), pa.int64()),
                        pa.array(at, pa.int64()),
                        pa.array(low, pa.int32()),
                        pa.array(high, pa.int32()),
                        pa.array([row["open"] for row in rows], pa.bool_()),
                        pa.array(hulls, pa.binary()),
                    ],
                    schema.names,
                )

    return joined.mapInArrow(run, schema).dropDuplicates([*PLACE])


NODES = (
    "key_a long, key_b long, at long, low int, high int, open boolean, core long, hull binary"
)


def cells(located: DataFrame, width: int) -> DataFrame:
    """The ranges of offsets of located(.., hull_bytes), cut at multiples of ``width``.

    The core of a cell is what all of its windows share, at the cell's full width.
    """
    schema = StructType.fromDDL(NODES)
    names = ["key_a", "key_b", "at", "low", "high", "open"]

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            whose, lows, highs, cores, hulls = [], [], [], [], []
            rows = zip(
                batch.column("low").to_pylist(),
                batch.column("high").to_pylist(),
                batch.column("from").to_pylist(),
                batch.column("to").to_pylist(),
                batch.column("hull_bytes").to_pylist(),
            )
            for row, (_, top, low, high, data) in enumerate(rows):
                for cell in range(low // width * width, high + 1, width):
                    a, b = max(low, cell), min(high, cell + width - 1)
                    core = data[top - cell : top - cell - width + 1 + LENGTH]
                    whose.append(row)
                    lows.append(a)
                    highs.append(b)
                    cores.append(xxhash.xxh3_64_intdigest(core, cell))
                    hull = data[top - b : top - a + LENGTH]
                    hulls.append(xxhash.xxh3_128_digest(hull, hull_seed(a, b)))
            at = pa.array(whose, pa.int64())
            kept = {name: batch.column(name).take(at) for name in ("key_a", "key_b", "at", "open")}
            kept |= {
                "low": pa.array(lows, pa.int32()),
                "high": pa.array(highs, pa.int32()),
                "core": pa.array(signed(cores)),
                "hull": pa.array(hulls, pa.binary()),
            }
            return pa.record_batch([kept[name] for name in schema.names], schema.names)

        return work

    assert names == schema.names[:6]
    return map_slices(located, schema, factory)


def repeated_ranges(index: SuffixIndex, texts: DataFrame) -> DataFrame:
    """(key_a, key_b, at, low, high): all windows that occur twice, as ranges of offsets.

    Drops the index, and each table once the next is stored, as all of them are large.
    """
    entries = materialize(
        index.repeated().withColumn("open", F.lit(True)), "repeated"
    )
    index.drop()
    settled, further, stored = settle(entries)
    located = materialize(contexts(texts, further), "contexts")
    discard_each(stored)
    whole = located.withColumn("from", F.col("low")).withColumn("to", F.col("high"))
    coarse = materialize(cells(whole, CELL), "cells")
    settled_cells, further, stored = settle(coarse)
    # A cell lies in the range of one suffix: its bytes are in that one's hull.
    wanted = further.select(
        "key_a", "key_b", "at", F.col("low").alias("from"), F.col("high").alias("to"), "open"
    )
    parts = (
        located.drop("open")
        .join(wanted, ["key_a", "key_b", "at"])
        .filter("`from` >= low AND `to` <= high")
    )
    single = materialize(cells(parts, 1), "windows")
    discard_each([*stored, located])
    settled_windows, _, stored = settle(single)
    discard_each(stored)
    return settled.unionByName(settled_cells).unionByName(settled_windows)


def spans_of(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching [start, end) as maximal runs."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(start, end) for start, end in out]


def build_index(spark: SparkSession, suffixed: DataFrame, batches: int) -> SuffixIndex:
    index = SuffixIndex()
    entries = suffixed.select("key_a", "key_b", F.inline("suffixes"))
    for at in range(batches):
        index.add(entries.filter(F.pmod("key_a", F.lit(batches)) == at))
    return index


def _measured_spans(
    docs: DataFrame, text: str, carry: Sequence[str], batches: int
) -> tuple[DataFrame, DataFrame]:
    """(row, key_a, key_b, n_bytes, sha256) of all documents, and the spans of those that have any."""
    suffixed = materialize(with_suffixes(docs, text, carry), "suffixes")
    index = build_index(docs.sparkSession, suffixed, batches)
    measured = materialize(suffixed.drop("suffixes"), "measured")
    discard(suffixed)
    texts = docs.select(*row_key(docs), F.col(text).alias("text"))
    ranges = repeated_ranges(index, texts)
    spans = materialize(
        ranges.select(
            "key_a",
            "key_b",
            (F.col("at") - F.col("high")).alias("start"),
            (F.col("at") - F.col("low") + LENGTH).alias("end"),
        )
        .distinct()
        .groupBy("key_a", "key_b")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans")),
        "spans",
    )
    discard(ranges)
    return measured, spans


def without_repeats(
    docs: DataFrame,
    text: str = "text",
    carry: Sequence[str] | None = None,
    batches: int = BATCHES,
) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept) for each document.

    ``kept`` holds the bytes left over of a document that lost some, else null: such a
    document is whole. Cuts may fall inside a character, so it is binary.
    """
    with dropping_shuffles(docs.sparkSession):
        measured, spans = _measured_spans(docs, text, carry or docs.columns, batches)
    whole = measured.join(spans, ["key_a", "key_b"], "left_anti").select(
        "row",
        "n_bytes",
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"),
    )
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns])
    affected = docs.select(carried.alias("row"), *row_key(docs), F.col(text).alias("text")).join(
        spans, ["key_a", "key_b"]
    )
    return whole.unionByName(_cut(affected))


def _cut(affected: DataFrame) -> DataFrame:
    source = affected.select("row", "text", "spans")
    more = StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    schema = StructType([source.schema["row"], *more.fields])

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for data, ranges in zip(utf8(batch.column("text")), batch.column("spans")):
                pairs = zip(
                    ranges.values.field("start").to_pylist(), ranges.values.field("end").to_pylist()
                )
                spans, at, left = spans_of(list(pairs)), 0, []
                for start, end in spans:
                    left.append(data[at:start])
                    at = end
                kept = b"".join([*left, data[at:]])
                digest = hashlib.sha256(kept).hexdigest()
                out.append((len(data), len(data) - len(kept), len(spans), digest, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            return pa.record_batch([batch.column("row"), *columns], schema.names)

        return work

    return map_slices(source, schema, factory)
