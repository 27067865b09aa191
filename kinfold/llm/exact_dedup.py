"""Exact duplicates by content-defined chunk recipes.

A text without white space is cut where a gear hash of its last 32 bytes has
twelve zero bits, so equal texts are cut alike. A text's recipe is the ordered
list of its chunks' 128-bit digests. Each chunk's bytes are moved once, to check
that no digest stands for two byte strings (copies are merged before the
shuffle); where one does, its strings are numbered and the numbers join the
recipes that hold them. From there on only recipes move, never texts.

Null texts count as empty; all texts without visible characters are equal to one
another. Rows that repeat count each. A null ``doc_id`` sorts after all others as keeper.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import filled, row_key, sized_batches, stream
from kinfold.session import durable

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 32
MASK_BITS = 12
LEAST_CHUNK = 1 << 10
MOST_CHUNK = 1 << 16

_GEAR = (stream(256, 2) >> np.uint64(32)).astype(np.uint32)


def _bare(texts: pa.Array) -> list[bytes]:
    return [t.translate(None, SPACES) for t in filled(texts).cast(pa.binary()).to_pylist()]


def _cuts(data: bytes) -> list[int]:
    """Ends of the chunks; a cut depends on the bytes before it only."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # doubles the window: h[i] covers the last 2 * span bytes
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, 2 * span
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > MOST_CHUNK:
            last += MOST_CHUNK
            out.append(last)
        if mark - last >= LEAST_CHUNK or mark == n and mark > last:
            out.append(mark)
            last = mark
    return out


def chunks_of(data: bytes) -> list[bytes]:
    edges = [0, *_cuts(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _digest(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, row_key, n_points, text_sha256, recipe), one row per row of ``docs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            bare = _bare(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pc.utf8_length(filled(batch.column("text"))).cast(pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bare], pa.string()),
                    pa.array([b"".join(_digest(c, digest_bytes) for c in chunks_of(b)) for b in bare], pa.binary()),
                ],
                names=["doc_id", "row_key", "n_points", "text_sha256", "recipe"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row_key"), "text")
    return keyed.mapInArrow(cut, "doc_id long, row_key string, n_points long, text_sha256 string, recipe binary")


def _chunk_rows(docs: DataFrame, digest_bytes: int, placed: bool) -> DataFrame:
    """(digest, chunk), with ``placed`` also (doc_id, text_sha256, place)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            bare = _bare(batch.column("text"))
            parts = [chunks_of(b) for b in bare]
            flat = [c for p in parts for c in p]
            columns = [pa.array([_digest(c, digest_bytes) for c in flat], pa.binary()), pa.array(flat, pa.binary())]
            names = ["digest", "chunk"]
            if placed:
                times = np.array([len(p) for p in parts], np.int64)
                columns += [
                    batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(parts)), times))),
                    pa.array([hashlib.sha256(b).hexdigest() for b, p in zip(bare, parts, strict=True) for _ in p], pa.string()),
                    pa.array([i for p in parts for i in range(len(p))], pa.int64()),
                ]
                names += ["doc_id", "text_sha256", "place"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", doc_id long, text_sha256 string, place long" if placed else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "digest binary, chunk binary" + more)


def shared_digests(docs: DataFrame, digest_bytes: int = 16) -> DataFrame | None:
    """(digest, chunk, variant) of digests that stand for more than one byte string; None if all stand for one."""
    strings = _chunk_rows(docs, digest_bytes, False).groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    clashing = durable(strings.groupBy("digest").agg(F.count("one").alias("n")).where("n > 1"))
    if clashing.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("digest").orderBy("chunk")) - 1
    return strings.join(clashing, "digest").select("digest", "chunk", number.alias("variant"))


def _grouped(docs: DataFrame, digest_bytes: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows with their recipes, the groups (best, group_size), and the columns that tie them.

    Of equal texts the row with the most code points is best, then the one with the smallest ``doc_id``.
    """
    rows = durable(recipes(docs, digest_bytes))
    clashes = shared_digests(docs, digest_bytes)
    key = ["recipe"]
    if clashes is not None:
        numbers = (
            _chunk_rows(docs, digest_bytes, True).join(clashes, ["digest", "chunk"])
            .groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("place", "variant"))).alias("variants"))
            .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "variants")
        )
        rows = rows.join(numbers, rows.doc_id.eqNullSafe(numbers._id) & (rows.text_sha256 == numbers._sha), "left").withColumn("variants", F.coalesce(F.to_json("variants"), F.lit(""))).drop("_id", "_sha")
        key = ["recipe", "variants"]
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "row_key"))
    groups = durable(rows.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))  # apart, so that a hot recipe's rows can be split in the join
    return rows, groups, key


def keepers(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """(row_key): the best row of each group of equal texts, whatever ids it shares."""
    return _grouped(docs, digest_bytes)[1].select(F.col("best.row_key").alias("row_key"))


def duplicate_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``; ``kept`` tells by id, :func:`keepers` by row."""
    rows, groups, key = _grouped(docs, digest_bytes)
    return rows.join(groups, key).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), "text_sha256"
    )
