"""Helpers that the document operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows that a Python step looks at together. Long texts make a slice larger, never longer.
SLICE_ROWS = 500

Work = Callable[[pa.RecordBatch], pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_slices(df: DataFrame, schema: str | StructType, factory: Callable[[], Work]) -> DataFrame:
    """Run ``factory()`` once per task and its result on slices of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(start, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def map_parts(
    df: DataFrame, schema: str | StructType, factory: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]
) -> DataFrame:
    """Run ``factory()`` once per task; its result makes some batches of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def text_parts(batch: pa.RecordBatch, docs: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``docs`` rows and, but for longer texts, ``n_bytes`` bytes of ``text``."""
    start, size = 0, 0
    for at, length in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if at > start and (size + (length or 0) > n_bytes or at - start >= docs):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += length or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def text_udf(work: Callable[[list[bytes | None]], list[tuple]], schema: str) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct; the other columns stay in the JVM.

    ``work`` gets some texts and returns a tuple of values for each. Spark must not repeat it
    for each use of a field, so the function counts as one that may give other values.
    """
    fields = StructType.fromDDL(schema).fields
    names = [field.name for field in fields]
    kinds = [to_arrow_type(field.dataType) for field in fields]

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), SLICE_ROWS):
            found = work(utf8(texts.slice(start, SLICE_ROWS)))
            columns = list(zip(*found)) or [()] * len(names)
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            parts.append(pa.StructArray.from_arrays(arrays, names))
        empty = pa.array([], pa.struct(list(zip(names, kinds))))
        return pa.concat_arrays(parts) if parts else empty

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StructType(fields)).asNondeterministic()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes; null stays None."""
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes that together name a row by all its columns: equal rows get equal keys."""
    columns = [F.col(f"`{name}`") for name in df.columns]
    return [
        F.xxhash64(F.lit(1), *columns).alias("key_a"),
        F.xxhash64(F.lit(2), *columns).alias("key_b"),
    ]
