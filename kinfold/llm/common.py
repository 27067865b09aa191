"""Arrow text buffers inside tasks, and the tables the queries read."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Bytes of text that one vectorised step works on; one longer text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(docs: DataFrame) -> list[Column]:
    """The columns as they are, whatever dots or backticks their names hold."""
    return [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, MapType) or isinstance(kind, StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _without_maps(column: Column, kind: DataType) -> Column:
    if not _holds_map(kind):
        return column
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda v: _without_maps(v, kind.elementType))
    if isinstance(kind, StructType):
        parts = [_without_maps(column.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(column.isNotNull(), F.struct(*parts))
    entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), _without_maps(e["value"], kind.valueType).alias("value")))
    return F.array_sort(entries)


def hashable(docs: DataFrame) -> list[Column]:
    """The columns in a form that Spark hashes: maps, which it refuses, as sorted arrays of their entries."""
    return [_without_maps(c, f.dataType) for c, f in zip(named(docs), docs.schema.fields, strict=True)]


def row_key(docs: DataFrame) -> Column:
    """128 bits of hash over all columns, nulls marked: rows that share it are repetitions of one row. Maps count by their entries, in any order."""
    columns = hashable(docs)
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), *marked)) for seed in (12, 13)])


def shared_folder(spark: SparkSession, what: str) -> str:
    """URI of a new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base if '://' in base else 'file://' + os.path.abspath(base)}/{what}-{uuid.uuid4().hex}"


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(texts, "") if texts.null_count else texts


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (one more entry for the end)."""
    texts = filled(texts)
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sized(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about ``limit`` bytes of text, so that a step's memory is bounded by the longest text."""
    _, offsets = packed(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut like :func:`sized` by their text column."""
    for batch in batches:
        start = 0
        for part in sized(batch.column(column), limit):
            yield batch.slice(start, len(part))
            start += len(part)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


def binaries(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column from the bytes of all values end to end."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
