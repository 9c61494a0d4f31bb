"""Token ids as Parquet list columns, and their metadata, in the order of the document ids.

The rows are dealt out by ranges of the id and sorted, so each file holds one range. A file
has a list column of token ids (dictionary encoded: a vocabulary is far smaller than a row
group) and plain columns for id, number of tokens and place (delta encoded). Row groups and
pages have fixed sizes, and Parquet's page indexes let a reader fetch a few documents, or
the metadata alone, without the ids.

A document's place among all ids is the place within its file, written with it, plus the
sizes of the files before; these are summed from the metadata on reading.

Texts are split at ASCII white space and, if they are simple, between letters, digits and signs.
Of a slice of documents each distinct part that the worker does not remember is encoded. That
gives the ids of the whole text for tokenizers that cut there before they merge, as this one
does; the tests compare it with whole texts.

Defined cases: a null or empty text has the end id only. Null ids come first. Rows with
equal ids are ordered by hashes of all columns; equal rows are interchangeable.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tallymill.llm.common import map_parts, map_slices, row_key, text_parts, utf8
from tallymill.session import bound_arrow_batches, fresh_path

END_ID = 1
ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_ROWS = 1_000
#: Parts that a worker remembers from before and since, and the longest of them.
KNOWN_PARTS = 200_000
LONGEST_PART = 64
#: Plain parts that are encoded as one text.
JOINED_PARTS = 2_000
#: Documents, and about the bytes of text, that are encoded together.
SLICE_DOCS, SLICE_BYTES = 2_000, 8_000_000

#: Letters that stay one letter in lower case and in composed form, and ASCII signs but the
#: apostrophe (which starts contractions) and ``<`` (which starts special tokens).
PLAIN_LINE = re.compile(
    rb"(?m)^(?:[A-Za-z!-&(-/:;=?-@\[-`{-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+$"
)
#: Such signs, and lines of such letters in lower case: one run for the tokenizer.
SIGNS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
LOWER_LINE = re.compile(rb"(?m)^(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+$")
#: Bytes of texts that may be lower-cased first, as the tokenizer does it anyway: ASCII and
#: the letters above. Marks that combine with letters are not among them.
SIMPLE = bytes([*range(192), 0xC3])
SPACE, LETTER, SIGN, DIGIT = 0, 1, 2, 4
KIND = np.full(256, SIGN, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[32] = SPACE
#: Kinds by byte where a text may be cut, none for white space and the apostrophe; and whether
#: it is cut between two kinds. Each digit is a token.
CUT_KIND = KIND.copy()
CUT_KIND[[*range(48, 58)]] = DIGIT
CUT_KIND[[*range(9, 14), 39]] = SPACE
CUT_KIND = CUT_KIND.tobytes()
CUT = np.zeros(256, bool)
CUT[[8 * a + b for a in (LETTER, SIGN, DIGIT) for b in (LETTER, SIGN, DIGIT) if a != b or a == DIGIT]] = True
CUT = CUT.tobytes()
#: Signs among the letters above: texts with them are not cut.
SIGN_LETTERS = ("×".encode(), "÷".encode())


def is_simple(text: bytes) -> bool:
    return not text.translate(None, SIMPLE) and b"<|" not in text


def cut_apart(texts: list[bytes | None]) -> pa.Array:
    """The texts to encode, simple ones in lower case and with a blank between letters, digits
    and signs, which leaves far fewer distinct parts.

    The tokenizer cuts there anyway, but for apostrophes, which may start contractions.
    """
    made, whole, at = [], [], 0
    for text in texts:
        simple = not text or is_simple(text)
        own = (text.decode().lower().encode() if simple else text) if text else b""
        if not simple or any(sign in own for sign in SIGN_LETTERS):
            whole.append((at, at + len(own)))
        made.append(own)
        at += len(own)
    joined = b"".join(made)
    offsets = np.cumsum([0, *map(len, made)])
    kinds = np.frombuffer(joined.translate(CUT_KIND), np.uint8)
    if whole:
        kinds = kinds.copy()
        for start, end in whole:
            kinds[start:end] = SPACE
    pairs = (kinds[:-1] << 3) | kinds[1:]
    cuts = np.flatnonzero(np.frombuffer(pairs.tobytes().translate(CUT), bool)) + 1
    data = np.insert(np.frombuffer(joined, np.uint8), cuts, 32)
    offsets = (offsets + np.searchsorted(cuts, offsets)).astype(np.int32)
    return pa.StringArray.from_buffers(len(made), pa.py_buffer(offsets), pa.py_buffer(data))


def word_runs(joined: bytes) -> np.ndarray:
    """For each part of a text joined by blanks, how many runs of letters or signs it has.

    The tokenizer merges within such runs only, and ends each with a token of its own kind.
    """
    kinds = KIND[np.frombuffer(joined, np.uint8)]
    starts = kinds != SPACE
    starts[1:] &= kinds[1:] != kinds[:-1]
    at = np.cumsum(starts)
    ends = np.concatenate((at[kinds == SPACE], at[-1:]))
    return np.diff(ends, prepend=0)


#: Encoders of this process by tokenizer file: workers are used again, and parts come again.
_ENCODERS: dict[str, PartEncoder] = {}


def encoder_of(tokenizer_file: str) -> PartEncoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_file] = PartEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


class PartEncoder:
    """Encodes texts part by part, with a tokenizer that works on parts.

    Most new parts are a run of letters, between signs. Runs are encoded together, joined by
    blanks, by a copy of the tokenizer that only merges, as nothing else changes them; the ids
    are dealt out by the tokens that end a run. Other plain parts are encoded together by the
    tokenizer itself, and those that are not plain one by one.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.merger = Tokenizer(self.tokenizer.model)
        # Parts are remembered here; a cache of the model would only be looked up in vain.
        self.tokenizer.model._resize_cache(0)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        #: Ids of parts met lately, and of those met before; the empty part has none.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends_run = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_run[[at for token, at in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, texts: list[bytes], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(
            [text.decode() for text in texts], add_special_tokens=False
        )
        return [np.array(x.ids, "<u4") for x in found]

    def _one_by_one(self, parts: list[bytes]) -> dict[bytes, bytes]:
        return {part: ids.tobytes() for part, ids in zip(parts, self._encode(parts))}

    def _joined(self, parts: list[bytes], tokenizer, runs_of) -> dict[bytes, bytes]:
        """Ids of parts encoded together; ``runs_of`` says how many runs each of them has."""
        out = {}
        groups = [parts[at : at + JOINED_PARTS] for at in range(0, len(parts), JOINED_PARTS)]
        for group in groups:
            text = b" ".join(group)
            (ids,) = self._encode([text], tokenizer)
            ends = np.flatnonzero(self.ends_run[ids])
            runs = np.cumsum(runs_of(text, group))
            if len(runs) != len(group) or runs[-1] != len(ends):
                out |= self._one_by_one(group)
                continue
            bounds = (4 * (ends[runs - 1] + 1)).tolist()
            slices = map(slice, [0, *bounds], bounds)
            out.update(zip(group, map(ids.tobytes().__getitem__, slices)))
        return out

    def learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct parts, and of the runs of letters in them."""
        letters = LOWER_LINE.findall(b"\n".join(parts))
        others = list(set(parts).difference(letters))
        cores = [part.strip(SIGNS) for part in others]
        new = set(cores).difference(self.known, letters)
        letters += LOWER_LINE.findall(b"\n".join(new))
        out = self._joined(letters, self.merger, lambda _, group: np.ones(len(group), np.int64))
        rest, signs, framed = [], set(), []
        for part, core in zip(others, cores):
            ids = out.get(core)
            if ids is None and core in self.known and LOWER_LINE.fullmatch(core):
                ids = self.known[core]
            if ids is None:
                rest.append(part)
            else:
                left, _, right = part.partition(core)
                signs.update((left, right))
                framed.append((part, left, ids, right))
        plain = PLAIN_LINE.findall(b"\n".join(rest))
        out |= self._joined(plain, self.tokenizer, lambda text, _: word_runs(text))
        out |= self._one_by_one(list({*rest, *signs}.difference(plain)))
        for part, left, ids, right in framed:
            out[part] = out[left] + ids + out[right]
        return out

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts as little-endian unsigned 32-bit integers."""
        known, before = self.known, self.before
        missing = [part for part in parts if part not in known]
        known.update({part: before[part] for part in missing if part in before})
        new = [part for part in missing if part not in known]
        if new:
            known.update(self.learn(new))
        found = list(map(known.__getitem__, parts))
        for part in new:
            if len(part) > LONGEST_PART:
                del known[part]
        if len(known) > KNOWN_PARTS:
            self.known, self.before = {}, known
        return found

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        split = pc.ascii_split_whitespace(cut_apart(texts))
        parts = split.flatten().dictionary_encode()
        found = self.ids_of(parts.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
        ends = np.concatenate(([0], np.cumsum(sizes[parts.indices.to_numpy()])))
        return ids.take(parts.indices).flatten().to_numpy(), np.diff(ends[split.offsets.to_numpy()])

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode(texts)
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
) -> None:
    """Write the documents' ids below ``path``, a file for each range of ``key``."""
    order = ["key", "key_a", "key_b"]
    ranged = (
        docs.select(F.col(key).alias("key"), *row_key(docs), F.col(text).alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .select("key", "part", "text")
    )
    schema = StructType([ranged.schema["key"], ranged.schema["part"]])
    schema = schema.add("part_start", "long").add("n_tokens", "long").add("ids", ArrayType(IntegerType()))

    def factory():
        # Workers are used again: what earlier tasks freed goes back before the encoder grows.
        pa.default_memory_pool().release_unused()
        encoder, at = encoder_of(tokenizer_file), 0

        def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal at
            ids, sizes = encoder.encode(utf8(part.column("text")))
            values = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            made = [
                part.column("key"),
                part.column("part"),
                pa.array(starts, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())),
            ]
            return pa.record_batch(made, ["key", "part", "part_start", "n_tokens", "ids"])

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            return map(encoded, text_parts(batch, SLICE_DOCS, SLICE_BYTES))

        return work

    written = map_parts(ranged, schema, factory).withColumnRenamed("key", key)
    options = {
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        **{
            f"parquet.enable.dictionary#{name}": "false"
            for name in (key, "part", "part_start", "n_tokens")
        },
    }
    written.write.options(**options).parquet(path)


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows(part, part_start, ..) with ``start``, the place among the ids of all files.

    There is one sum per file; their running total is a window over as many rows.
    """
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    start = (F.col("_before") + F.col("part_start")).alias("start")
    return rows.join(offsets, "part").select("*", start).drop("_before")


def token_places(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """The columns asked for, ``n_tokens`` and ``start`` of each document, from metadata."""
    files = spark.read.parquet(path)
    rows = files.select(*columns, "part", "part_start", "n_tokens")
    return _placed(rows, files).select(*columns, "start", "n_tokens")


def id_sums(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, part_start, n_tokens, ids_crc32): checksums of the ids as 32-bit numbers."""
    names = [key, "part", "part_start", "n_tokens"]
    source = files.select(*names, "ids")
    schema = StructType([source.schema[name] for name in names]).add("ids_crc32", "long")

    def factory():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            kept = [batch.column(name) for name in names]
            return pa.record_batch([*kept, pa.array(sums, pa.int64())], schema.names)

        return work

    return map_slices(source, schema, factory)


def token_table(docs: DataFrame, tokenizer_file: str, key: str = "doc_id") -> DataFrame:
    """Write the documents' ids to a fresh folder and read places and checksums back."""
    spark = docs.sparkSession
    bound_arrow_batches(spark, SLICE_DOCS)
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_file, key)
    files = spark.read.parquet(path)
    # The sums first: only narrow rows then meet the places of the files.
    return _placed(id_sums(files, key), files).select(key, "start", "n_tokens", "ids_crc32")
