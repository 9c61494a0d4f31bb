"""Language identification with interpolated Kneser-Ney models of characters.

Texts become lower-case letters with single spaces between words. The training texts of each
language are counted as strings of ``ORDER`` characters, over all training documents. Each
language's model is Kneser-Ney: an absolute discount, and lower orders that count in how many
contexts a character occurs instead of how often.

A string of four characters is a 64-bit number (16 bits each), so an order's strings are
sorted arrays that a binary search finds. Beside them stand the counts in every language.
Counts of all orders, of their contexts, and discounts are made in Spark over all strings;
none is left out. The model is stored as sorted files in the shared folder, ``FILE_ROWS`` rows
each. A task looks the distinct strings of its documents up, opens only files that hold some
of them, and keeps ``KEPT_ROWS`` rows of them at most. A text takes the language of the least
cross-entropy per character.

Rejection is calibrated on texts that the model has not seen: the training texts are dealt by
a hash into ``FOLDS`` folds, copies into the same one, and each is scored by models of the other
folds. Per language the limit is a quantile of the cross-entropy of all its own texts, from a
histogram; texts beyond it are marked, whatever they are. A language that only one fold holds
takes the limit from the model of all.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Ties go to the
first language by code point. Without training texts every text is ``und``. Null languages
are never learned. Letters outside the first 65,536 code points are one letter.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.llm.common import map_slices, strings
from tallymill.session import discard, materialize

ORDER = 4
#: Rows of a file of the stored model, and of files that a process keeps.
FILE_ROWS = 500_000
KEPT_ROWS = 8_000_000
#: Numbers of a table, strings times languages, that are computed together.
CELLS = 1 << 20
REJECTED_SHARE = 0.001
FOLDS = 3
#: Cross-entropies are counted in cells of this width.
CELL = 1 / 1024
UNKNOWN = "und"
#: Characters that are counted or scored together.
BLOCK_CHARS = 1 << 20
#: A score compares evidence of so many characters at most.
EVIDENCE_CHARS = 100

SPACE = 32
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point below 65,536 itself if it is a letter, else a space."""
    global _LETTERS
    if _LETTERS is None:
        points = np.arange(1 << 16, dtype=np.uint16)
        known = np.fromiter((chr(point).isalpha() for point in range(1 << 16)), bool, 1 << 16)
        _LETTERS = np.where(known, points, np.uint16(SPACE))
    return _LETTERS


def characters(text: str) -> np.ndarray:
    """The text as letters with single spaces, one before and one after; empty if no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points >= 1 << 16
    found = letters()[np.where(high, 0, points).astype(np.uint16)]
    if high.any():
        rare = [at for at in np.flatnonzero(high) if chr(points[at]).isalpha()]
        found[rare] = 0xFFFF
    padded = np.concatenate(([SPACE], found, [SPACE])).astype(np.uint16)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != SPACE) | (padded[:-1] != SPACE)
    padded = padded[keep]
    return padded if len(padded) > 1 else padded[:0]


def packed(chars: np.ndarray) -> np.ndarray:
    """The ORDER characters up to each but the first, as numbers; spaces come before."""
    full = np.concatenate((np.full(ORDER - 2, SPACE, np.uint16), chars)).astype(np.uint64)
    n = len(chars) - 1
    found = np.zeros(n, np.uint64)
    for at in range(ORDER):
        found <<= np.uint64(16)
        found |= full[at : at + n]
    return found


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts with letters, as packed strings, in groups of bounded size."""
    rows: list[int] = []
    found: list[np.ndarray] = []
    size = 0
    for row, text in enumerate(texts):
        chars = characters(text) if text else ()
        if len(chars):
            rows.append(row)
            found.append(packed(chars))
            size += len(chars)
        if size >= BLOCK_CHARS:
            yield rows, found
            rows, found, size = [], [], 0
    if rows:
        yield rows, found


def _foldwise(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(fold, lang, text) of documents."""
    fold = F.pmod(F.xxhash64(F.col(text)), F.lit(FOLDS)).cast("int").alias("fold")
    return docs.select(fold, F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))


def fold_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(fold, lang, string, n) over all rows of ``docs``; summed in the task before the shuffle."""

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            groups = list(zip(batch.column("fold").to_pylist(), strings(batch.column("lang"))))
            texts = strings(batch.column("text"))
            folds, names, numbers, counts = [], [], [], []
            for fold, name in sorted(set(groups)):
                own = [value for value, it in zip(texts, groups) if it == (fold, name)]
                # A part of the counts each time: Spark sums them up.
                for _, found in blocks(own):
                    values, n = np.unique(np.concatenate(found), return_counts=True)
                    folds += [fold] * len(values)
                    names += [name] * len(values)
                    numbers.append(values.view(np.int64))
                    counts.append(n)
            empty = [np.zeros(0, np.int64)]
            return pa.record_batch(
                [
                    pa.array(folds, pa.int32()),
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate(numbers or empty)),
                    pa.array(np.concatenate(counts or empty).astype(np.int64)),
                ],
                ["fold", "lang", "string", "n"],
            )

        return work

    source = _foldwise(docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()), text, lang)
    counted = map_slices(source, "fold int, lang string, string long, n long", factory)
    return counted.groupBy("fold", "lang", "string").agg(F.sum("n").alias("n"))


def _summed(counts: DataFrame) -> DataFrame:
    """(lang, string, n) over the folds."""
    return counts.groupBy("lang", "string").agg(F.sum("n").alias("n"))


def string_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, string, n) over all rows of ``docs``."""
    return _summed(fold_counts(docs, text, lang))


def order_counts(counts: DataFrame) -> dict[int, DataFrame]:
    """By length (lang, string, n): how often, or for lower orders in how many contexts."""
    tables = {ORDER: counts}
    for length in range(ORDER - 1, 0, -1):
        end = F.col("string").bitwiseAND(F.lit((1 << 16 * length) - 1))
        shorter = tables[length + 1].groupBy("lang", end.alias("string"))
        tables[length] = materialize(shorter.agg(F.count("*").alias("n")), "strings")
    return tables


def _part(length: int, of_contexts: bool) -> int:
    """The number of a table among those that are stored together."""
    return 2 * length + of_contexts


def stored_model(tables: dict[int, DataFrame]) -> DataFrame:
    """(part, key, lang, n, kinds) sorted by part and key, about ``FILE_ROWS`` rows a file.

    A key is a string with its count, or a context with the count of all its strings and how
    many different ones there are.
    """
    parts = []
    for length, table in tables.items():
        own = F.lit(_part(length, False)).alias("part")
        parts.append(
            table.select(own, F.col("string").alias("key"), "lang", "n", F.lit(0).cast("long").alias("kinds"))
        )
        context = F.shiftrightunsigned("string", 16).alias("key")
        totals = table.groupBy(context, "lang").agg(
            F.sum("n").alias("n"), F.count("*").alias("kinds")
        )
        own = F.lit(_part(length, True)).alias("part")
        parts.append(totals.select(own, "key", "lang", "n", "kinds"))
    rows = reduce(DataFrame.unionByName, parts)
    # A string has at most one context of its own.
    n_files = 2 * sum(table.count() for table in tables.values()) // FILE_ROWS + 1
    dealt = rows.repartitionByRange(n_files, "part", "key")
    return materialize(dealt.sortWithinPartitions("part", "key", "lang"), "language-model")


class Store:
    """The stored model as tasks read it: only the files whose keys are wanted, some kept."""

    #: Files that this process has read, by path; the last used at the end.
    kept: OrderedDict[str, dict[int, tuple[np.ndarray, ...]]] = OrderedDict()

    def __init__(self, model: DataFrame, languages: list[str]) -> None:
        self.languages = languages
        ends = model.groupBy(F.input_file_name().alias("uri"), "part").agg(
            F.min("key").alias("first"), F.max("key").alias("last")
        )
        self.files: dict[int, list[tuple[int, int, str]]] = {}
        for row in ends.collect():
            self.files.setdefault(row.part, []).append((row.first, row.last, row.uri))
        for part in self.files.values():
            part.sort()

    def _read(self, uri: str) -> dict[int, tuple[np.ndarray, ...]]:
        if uri in Store.kept:
            Store.kept.move_to_end(uri)
            return Store.kept[uri]
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        with files.open_input_file(path) as source:
            rows = pq.read_table(source)
        names = pc.index_in(rows["lang"], pa.array(self.languages, pa.string()))
        columns = [rows[name].to_numpy() for name in ("part", "key")]
        columns += [names.to_numpy(), rows["n"].to_numpy(), rows["kinds"].to_numpy()]
        parts, starts = np.unique(columns[0], return_index=True)
        found = {}
        for part, start, end in zip(parts.tolist(), starts, [*starts[1:], len(columns[0])]):
            found[part] = tuple(column[start:end] for column in columns[1:])
        Store.kept[uri] = found
        held = {uri: sum(len(x[0]) for x in file.values()) for uri, file in Store.kept.items()}
        while len(Store.kept) > 1 and sum(held.values()) > KEPT_ROWS:
            held.pop(Store.kept.popitem(last=False)[0])
        return found

    def find(self, part: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, kinds) of each wanted key, a column per language; 0 where it was not seen."""
        out = np.zeros((2, len(wanted), len(self.languages)))
        wanted = wanted.view(np.int64)
        order = np.argsort(wanted, kind="stable")
        ordered = wanted[order]
        for first, last, uri in self.files.get(part, []):
            begin, end = np.searchsorted(ordered, first), np.searchsorted(ordered, last, "right")
            if begin == end:
                continue
            keys, langs, n, kinds = self._read(uri)[part]
            low = np.searchsorted(keys, ordered[begin:end])
            many = np.searchsorted(keys, ordered[begin:end], "right") - low
            rows = np.repeat(order[begin:end], many)
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out[0, rows, langs[at]] = n[at]
            out[1, rows, langs[at]] = kinds[at]
        return out[0], out[1]

    def keys(self, part: int) -> np.ndarray:
        """All keys of one table, for models that fit into memory."""
        found = [self._read(uri)[part][0] for _, _, uri in self.files.get(part, [])]
        return np.unique(np.concatenate(found or [np.zeros(0, np.int64)])).view(np.uint64)


class Order:
    """One order for all languages, looked up in the stored model."""

    def __init__(self, length: int, store: Store, discounts: np.ndarray, lower) -> None:
        """discounts: one per language."""
        self.length, self.store, self.discounts, self.lower = length, store, discounts, lower
        self.mask = np.uint64((1 << 16 * (length - 1)) - 1)

    @property
    def keys(self) -> np.ndarray:
        return self.store.keys(_part(self.length, False))

    def chances(self, wanted: np.ndarray) -> np.ndarray:
        """Probabilities of the last character given the others, a column per language."""
        n, _ = self.store.find(_part(self.length, False), wanted)
        contexts, which = np.unique(wanted >> np.uint64(16), return_inverse=True)
        totals, kinds = self.store.find(_part(self.length, True), contexts)
        # A context that a language never saw leaves everything to the lower order.
        weights = np.where(totals > 0, self.discounts * kinds / np.maximum(totals, 1), 1.0)
        ends, place = np.unique(wanted & self.mask, return_inverse=True)
        out = np.where(n > 0, n - self.discounts, 0.0) / np.maximum(totals, 1)[which]
        out += weights[which] * self.lower.chances(ends)[place]
        return out

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """Log probabilities of the last character given the others, a column per language."""
        distinct, which = np.unique(wanted, return_inverse=True)
        n_languages = len(self.store.languages)
        out = np.empty((len(distinct), n_languages), np.float32)
        step = max(1, CELLS // n_languages)
        for start in range(0, len(distinct), step):
            out[start : start + step] = np.log(self.chances(distinct[start : start + step]))
        return out[which]


class Uniform:
    def __init__(self, n_languages: int, n_characters: int) -> None:
        self.value, self.n = 1 / (n_characters + 1), n_languages

    def chances(self, wanted: np.ndarray) -> np.ndarray:
        return np.full((len(wanted), self.n), self.value)


class LanguageModels:
    """Kneser-Ney models of several languages; what tasks get is the way to the stored model."""

    def __init__(self, counts: DataFrame) -> None:
        """counts(lang, string, n) of strings of ORDER characters."""
        self.languages = sorted(row.lang for row in counts.select("lang").distinct().collect())
        self.model = Uniform(len(self.languages), 0)
        if not self.languages:
            return
        tables = order_counts(counts)
        store = Store(stored_model(tables), self.languages)
        model = Uniform(len(self.languages), tables[1].select("string").distinct().count())
        for length in range(1, ORDER + 1):
            model = Order(length, store, self._discounts(tables[length]), model)
        self.model = model
        for length in range(1, ORDER):
            discard(tables[length])

    def _discounts(self, table: DataFrame) -> np.ndarray:
        rare = table.groupBy("lang").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()
        found = {
            lang: min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
            for lang, once, twice in rare
        }
        return np.array([found[name] for name in self.languages])

    def entropies(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, characters, cross-entropy per character and language) of texts with letters."""
        for rows, found in blocks(texts):
            scores = self.model.scores(np.concatenate(found))
            sizes = np.array([len(x) for x in found])
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(scores, starts, axis=0, dtype=np.float64)
            for row, n, total in zip(rows, sizes.tolist(), sums):
                yield row, n, -total / n


def _models(counts: DataFrame) -> LanguageModels:
    stored = materialize(counts, "strings")
    models = LanguageModels(stored)
    discard(stored)
    return models


def train(training: DataFrame, text: str, lang: str) -> LanguageModels:
    """Models of the languages of ``training``, of all its strings."""
    return _models(string_counts(training, text, lang))


def train_folds(training: DataFrame, text: str, lang: str) -> tuple[LanguageModels, list[LanguageModels]]:
    """Models of all of ``training``, and for each fold models of the others.

    The texts are counted once.
    """
    counts = materialize(fold_counts(training, text, lang), "fold-strings")
    whole = _models(_summed(counts))
    others = [_models(_summed(counts.filter(F.col("fold") != fold))) for fold in range(FOLDS)]
    discard(counts)
    return whole, others


def rejection_limits(
    models: LanguageModels,
    learned: DataFrame,
    text: str,
    lang: str,
    folds: Sequence[LanguageModels] = (),
) -> np.ndarray:
    """Per language the cross-entropy that at most ``REJECTED_SHARE`` of its texts reach.

    Each text is scored by the models that ``folds`` has for its fold, or else by ``models``. All
    texts are counted, in cells of ``CELL``; the limit is the end of a cell.
    """
    rows = _foldwise(learned, text, lang)
    shared = rows.sparkSession.sparkContext.broadcast(list(folds) or [models] * FOLDS)

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, texts = strings(batch.column("lang")), strings(batch.column("text"))
            fold_of = batch.column("fold").to_numpy()
            own = []
            for fold, scorer in enumerate(shared.value):
                mine = [value if at == fold else None for value, at in zip(texts, fold_of)]
                for row, _, found in scorer.entropies(mine) if scorer.languages else ():
                    if langs[row] in scorer.languages:
                        own.append((langs[row], found[scorer.languages.index(langs[row])]))
            names, values = zip(*own) if own else ((), ())
            return pa.record_batch(
                [pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang", "value"]
            )

        return work

    found = map_slices(rows, "lang string, value double", factory)
    # A cross-entropy is at most the log of the number of characters, so cells are few.
    cell = F.floor(F.col("value") / CELL).alias("cell")
    cells = found.groupBy("lang", cell).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    upto = F.sum("n").over(own.orderBy("cell"))
    share = upto >= F.sum("n").over(own) * (1 - REJECTED_SHARE)
    limits = (
        cells.withColumn("beyond", share)
        .filter("beyond")
        .groupBy("lang")
        .agg(F.min("cell").alias("cell"))
    )
    by_name = {row["lang"]: (row["cell"] + 1) * CELL for row in limits.collect()}
    return np.array([by_name.get(name, np.inf) for name in models.languages])


def identify(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    lang: str = "lang",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(row, lang_pred, score, cross_entropy, rejected) for each document.

    ``training`` says which rows are learned from. ``score`` is the probability of the
    language among all, on the evidence of at most ``EVIDENCE_CHARS`` characters.
    """
    learned = docs.filter(training & F.col(text).isNotNull() & F.col(lang).isNotNull())
    models, folds = train_folds(learned, text, lang)
    limits = rejection_limits(models, learned, text, lang, folds)
    for at in np.flatnonzero(np.isinf(limits)):
        alone = learned.filter(F.col(lang).cast("string") == models.languages[at])
        limits[at] = rejection_limits(models, alone, text, lang)[at]
    shared = docs.sparkSession.sparkContext.broadcast((models, limits))
    carried = F.struct(*[F.col(f"`{name}`") for name in carry or docs.columns])
    source = docs.select(carried.alias("row"), F.col(text).alias("text"))
    more = StructType.fromDDL(
        "lang_pred string, score double, cross_entropy double, rejected boolean"
    )
    schema = StructType([source.schema["row"], *more.fields])

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            models, limits = shared.value
            out = [(UNKNOWN, 0.0, None, True)] * batch.num_rows
            texts = strings(batch.column("text")) if models.languages else []
            for row, n, found in models.entropies(texts):
                best = int(np.argmin(found))
                odds = np.exp((found[best] - found) * min(n, EVIDENCE_CHARS))
                value = float(found[best])
                name = models.languages[best]
                out[row] = (name, float(1 / odds.sum()), value, bool(value > limits[best]))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            return pa.record_batch([batch.column("row"), *columns], schema.names)

        return work

    return map_slices(source, schema, factory)
