"""How far the sources of a language differ in their words, by run-length encoded counts.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case. Each
language keeps the terms found in at least ``LEAST_DOCS`` of its documents. A source's share of
a term is a whole number of ``SCALE`` parts, two counts added to each term, and the distance of
two shares p and q is ``floor((p - q)^2 / (p + q))``. All arithmetic is on whole numbers.

The counts are summed in each task and then by Spark. Pairs of sources are compared on columns
of counts: the kept terms of a language are dealt into blocks of bounded size. A block orders
its terms so that equal counts stand together and run-length encodes the column of each
source. For a pair the boundaries of both columns' runs are merged; within a merged run both
counts stay the same, so one distance, multiplied by the length, stands for all its terms.
Terms that no source of a block's tiles has are one run more, of the kept terms left over.

Sources are dealt into tiles of about ``TILE_SOURCES``, and a block compares two tiles, so it
stays bounded for any number of sources; the result itself has a row for each ordered pair.

Defined cases: null texts, languages and sources count as ''. A text without terms, or an empty
one, still makes its source occur. A language without kept terms has distance 0 between all its
sources and no terms. Equal rows count as often as they occur. Ties in value are ordered by the
UTF-8 bytes of the item. An empty table has no rows. Other columns are not looked at. Totals of
a source up to 9e15 words are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import utf8
from tallymill.session import materialize

LEAST_DOCS = 10
SCALE = 1_000_000_000
ADDED = 2
TOP_TERMS = 10
#: Distinct (language, source, term) that a task holds before it hands them on.
HELD_TERMS = 200_000
#: Sources of a tile, and cells (terms times sources) of a block, about.
TILE_SOURCES = 64
BLOCK_CELLS = 100_000

#: Bytes of a term keep their value, A-Z become lower case, all others separate.
TERM_BYTES = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20
    for byte in range(256)
)
COUNTS = "lang string, source string, term string, count long, docs long"
PAIRS = "lang string, a string, b string, value long, terms long"
BLOCK = ["lang", "tile_a", "tile_b", "block"]


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's documents; each is held until there are too many."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def handed_on() -> pa.RecordBatch:
        rows = [
            (*group, term, n, docs[group][term])
            for group, found in counts.items()
            for term, n in found.items()
        ]
        counts.clear()
        docs.clear()
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        made = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        made[2] = made[2].cast(pa.string())
        return pa.record_batch(made, ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for group, text in zip(groups, utf8(batch.column("text"))):
            terms = terms_of(text)
            counts.setdefault(group, Counter()).update(terms)
            docs.setdefault(group, Counter()).update(set(terms))
        if sum(map(len, counts.values())) > HELD_TERMS:
            yield handed_on()
    yield handed_on()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs) of all terms of all documents."""
    named = docs.select(
        *[
            F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(alias)
            for name, alias in ((lang, "lang"), (source, "source"), (text, "text"))
        ]
    )
    found = named.mapInArrow(_counted, COUNTS)
    return found.groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), three digits at a time."""
    below = total + F.lit(ADDED).cast("long") * kept
    rest, digits = count + ADDED, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + F.call_function("div", rest, below)
        rest = rest % below
    return digits + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, below: int) -> np.ndarray:
    """As :func:`share`, of an array."""
    rest, digits = counts + ADDED, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // below
        rest %= below
    return digits + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class RunColumns:
    """The columns of counts of a block of terms, each as starts of runs and their values."""

    def __init__(self, cells: np.ndarray) -> None:
        """cells[source, term]: the terms are reordered so that equal counts stand together.

        The column with the most distinct counts leads, as the others follow it the least.
        """
        distinct = [len(np.unique(row)) for row in cells]
        order = np.lexsort(cells[np.argsort(distinct, kind="stable")])
        self.n_terms = cells.shape[1]
        self.starts, self.values = [], []
        for row in cells:
            ordered = row[order]
            changes = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
            starts = np.concatenate(([0], changes))
            self.starts.append(starts)
            self.values.append(ordered[starts])

    def merged(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pair's common runs: indexes into the runs of both columns, and lengths."""
        a, b = self.starts[left], self.starts[right]
        starts = np.union1d(a, b)
        lengths = np.diff(starts, append=self.n_terms)
        of_left = np.searchsorted(a, starts, "right") - 1
        of_right = np.searchsorted(b, starts, "right") - 1
        return of_left, of_right, lengths


def block_sums(cells: np.ndarray, belows: list[int], pairs: list[tuple[int, int]]) -> list[int]:
    """The distance of each pair of rows of ``cells[source, term]``, summed over the terms."""
    columns = RunColumns(cells)
    scaled = [shares(values, below) for values, below in zip(columns.values, belows)]
    sums = []
    for left, right in pairs:
        of_left, of_right, lengths = columns.merged(left, right)
        found = distances(scaled[left][of_left], scaled[right][of_right])
        sums.append(int((found * lengths).sum()))
    return sums


def _compared(cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of the pairs of ``sources`` over the terms of one block."""
    lang, tile_a, tile_b = (sources[name][0].as_py() for name in ("lang", "tile_a", "tile_b"))
    rows = sorted(zip(*[sources[name].to_pylist() for name in ("source", "tile", "below")]))
    names, tiles, belows = map(list, zip(*rows))
    pairs = [
        (x, y)
        for x in range(len(rows))
        for y in range(x + 1, len(rows))
        if {tiles[x], tiles[y]} == {tile_a, tile_b}
    ]
    terms = cells["term"].combine_chunks().dictionary_encode()
    n_terms = len(terms.dictionary)
    if n_terms:
        dense = np.zeros((len(rows), n_terms), np.int64)
        at = {name: row for row, name in enumerate(names)}
        of_source = cells["source"].combine_chunks().dictionary_encode()
        row_of = np.array([at[name] for name in of_source.dictionary.to_pylist()])
        dense[row_of[of_source.indices.to_numpy()], terms.indices.to_numpy()] = cells["count"].to_numpy()
        values = block_sums(dense, belows, pairs)
    else:
        values = [0] * len(pairs)
    made = [
        pa.array([lang] * len(pairs), pa.string()),
        pa.array([names[x] for x, _ in pairs], pa.string()),
        pa.array([names[y] for _, y in pairs], pa.string()),
        pa.array(values, pa.int64()),
        pa.array([n_terms] * len(pairs), pa.int64()),
    ]
    return pa.table(made, ["lang", "a", "b", "value", "terms"])


class Audit:
    """Counts of a table of documents, from which both parts of the audit start.

    ``counts`` (lang, source, term, count, lang_count) has the kept terms that occur, and
    ``groups`` (lang, source, total, lang_total, kept) every language and source.
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"):
        counted = materialize(term_counts(docs, text, lang, source), "term-counts")
        kept = (
            counted.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"))
            .filter(F.col("docs") >= LEAST_DOCS)
            .drop("docs")
        )
        kept = materialize(kept, "kept-terms")
        wanted = counted.select("lang", "source", "term", "count").join(kept, ["lang", "term"])
        self.counts = materialize(wanted, "kept-counts")
        present = docs.select(
            *[
                F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(alias)
                for name, alias in ((lang, "lang"), (source, "source"))
            ]
        ).distinct()
        totals = self.counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        by_lang = kept.groupBy("lang").agg(
            F.sum("lang_count").alias("lang_total"), F.count("*").alias("kept")
        )
        groups = present.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
        self.groups = materialize(groups.na.fill(0, ["total", "lang_total", "kept"]), "term-groups")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the distance of each source to each other one."""
        per_lang = self.groups.groupBy("lang").agg(
            F.count("*").alias("sources"), F.first("kept").alias("kept")
        )
        size = F.least(F.col("sources"), F.lit(2 * TILE_SOURCES)) * F.col("kept")
        sizes = per_lang.select(
            "lang",
            F.ceil(F.col("sources") / TILE_SOURCES).alias("tiles"),
            F.greatest(F.ceil(size / BLOCK_CELLS), F.lit(1)).alias("blocks"),
        )
        tile = F.pmod(F.xxhash64("source"), F.col("tiles"))

        def with_partner(df: DataFrame) -> DataFrame:
            """Each row once for each tile that its own is compared with."""
            dealt = df.join(sizes, "lang").withColumn("tile", tile)
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
            dealt = dealt.withColumn("other", other)
            return dealt.withColumns(
                {"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}
            )

        cells = with_partner(self.counts.select("lang", "source", "term", "count"))
        cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
        every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        below = F.col("total") + ADDED * F.col("kept")
        sources = with_partner(self.groups).withColumns({"below": below, "block": every_block})
        sums = (
            cells.select(*BLOCK, "source", "term", "count")
            .groupBy(*BLOCK)
            .cogroup(sources.select(*BLOCK, "source", "tile", "below").groupBy(*BLOCK))
            .applyInArrow(_compared, PAIRS)
            .groupBy("lang", "a", "b")
            .agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
        )
        zero = F.lit(0).cast("long")
        bare = self.groups.select("lang", "source", "kept", F.when(
            F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).alias("bare"))
        of_a = bare.select("lang", F.col("source").alias("a"), "kept", F.col("bare").alias("bare_a"))
        of_b = bare.select("lang", F.col("source").alias("b"), F.col("bare").alias("bare_b"))
        left_over = F.when(
            F.col("kept") > F.col("terms"),
            (F.col("kept") - F.col("terms")) * distance(F.col("bare_a"), F.col("bare_b")),
        ).otherwise(zero)
        full = sums.join(of_a, ["lang", "a"]).join(of_b, ["lang", "b"])
        full = full.select("lang", "a", "b", (F.col("value") + left_over).alias("value"))
        ends = F.explode(F.array(*[
            F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")
        ]))
        return full.select("lang", ends.alias("ends"), "value").select("lang", "ends.*", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): terms of which a source has more than its language."""
        found = self.counts.join(self.groups, ["lang", "source"])
        p = share(F.col("count"), F.col("total"), F.col("kept"))
        q = share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))
        found = found.withColumns({"p": p, "q": q}).filter("p > q")
        value = distance(F.col("p"), F.col("q")).alias("value")
        return found.select("lang", "source", F.col("term").alias("item"), value)


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(order).cast("int").alias("rank"),
    )


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the first terms, of each source."""
    counted = Audit(docs, text, lang, source)
    terms = _ranked(counted.terms(), "term").filter(F.col("rank") <= top_terms)
    return _ranked(counted.pairs(), "pair").unionByName(terms)
