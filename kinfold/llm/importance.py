"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are its runs of 1 to ``RUN`` consecutive words (bytes ``[0-9a-z\\x80-\\xFF]`` after lower-casing A-Z),
repeats counted, each dealt to one of ``BUCKETS`` buckets by its crc32. A bucket's gain is the log ratio of its smoothed
share in the target texts to that in the raw ones, in floored thousandths; a text's weight is the sum of its features' gains. With
Gumbel noise from a hash of the id added, the highest scores are a draw without replacement by importance.

**Batch concatenation.** The texts of a batch are joined with separator sentinels, so one regular
expression pass finds all their words. A run's crc32 is put together from those of its words: that of a joint string is the
first one's, carried over the length of what follows (a linear map, four table look-ups), xor the second one's. The documents'
offsets are searched among the words' places, which masks the runs that would cross from one document into the next, before all buckets of the
batch are counted at once.

Counts cover all rows of both tables. What the driver and the tasks hold of them are ``BUCKETS`` numbers, whatever the input. Texts are
read twice (counts, then weights) and never shuffled; only eligible (id, score) pairs are ordered, over ranges.

Null and empty texts have no features and weight 0. A null id counts as the empty string in the noise and is the smallest
in ties. Repeated rows are rows of their own; equal ids are ordered by a hash of the text. Empty tables give an empty result; an empty target or
raw table is smoothed like any other. Columns other than ``doc_id`` and the text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import packed, sized
from kinfold.llm.words import LOWER
from kinfold.session import durable

RUN = 3
BUCKETS = 10_000
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: No word byte, so that no word reaches over it.
_SENTINEL = b"\n"


#: What a crc32's low byte turns into when a zero byte follows.
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
#: Bytes that the tables carry over at once; longer words take several turns.
_FAR = 200


@cache
def _tables() -> np.ndarray:
    """For each length up to ``_FAR`` what each of a crc32's four bytes turns into when so many zero bytes follow."""
    carried = [np.array([[b << (8 * k) for b in range(256)] for k in range(4)], np.uint32)]
    for _ in range(_FAR):
        carried.append((carried[-1] >> np.uint32(8)) ^ _STEP[carried[-1] & np.uint32(0xFF)])
    return np.stack(carried).ravel()


def carried(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` carried over ``length`` bytes each: xor the crc32 of those bytes, it is that of the joint string."""
    tables, base = _tables(), np.minimum(length, _FAR) * 1024
    out = tables[base + (crc & np.uint32(0xFF))]
    for k in (1, 2, 3):
        out ^= tables[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(0xFF))]
    far = np.flatnonzero(length > _FAR)
    if len(far):
        out[far] = carried(out[far], length[far] - _FAR)
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of every text, and each text's number of words."""
    data, offsets = packed(texts)
    n = len(texts)
    lengths = np.diff(offsets)
    joined = np.full(len(data) + n, ord(_SENTINEL), np.uint8)
    kept = np.ones(len(joined), bool)
    kept[offsets[1:] + np.arange(n)] = False
    joined[kept] = LOWER[data]
    begin = offsets[:-1] + np.arange(n)  # of each document in the joined bytes
    crc32 = zlib.crc32
    found = [(m.start(), m.end(), crc32(m.group())) for m in _WORD.finditer(joined.tobytes())]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    start, end, crc = np.array(found, np.int64).T
    crc, length = crc.astype(np.uint32), end - start
    document = np.searchsorted(begin, start, "right") - 1
    spaced = carried(np.full(len(crc), crc32(b" "), np.uint32), length) ^ crc  # of a space and the word
    documents, buckets, run = [document], [crc % BUCKETS], crc
    for k in range(1, RUN):
        run = carried(run[:-1], length[k:] + 1) ^ spaced[k:]
        inside = document[:-k] == document[k:]
        documents.append(document[:-k][inside])
        buckets.append((run % BUCKETS)[inside])
    return np.concatenate(documents), np.concatenate(buckets).astype(np.int64), np.bincount(document, minlength=n)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of all features of all rows by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in sized(batch.column(0)):
                sums += np.bincount(features(part)[1], minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of every bucket's smoothed share in the target to that in the raw texts."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1.0) * (s.sum() + BUCKETS)) / ((s + 1.0) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio.tolist()], np.int64)


def weighed(gain: np.ndarray, text: str | Column = "text") -> Column:
    """struct(n_features, n_words, weight) of a text."""

    @F.arrow_udf("struct<n_features: bigint, n_words: bigint, weight: bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for part in sized(texts):
                document, bucket, words = features(part)
                order = np.argsort(document, kind="stable")
                edges = np.searchsorted(document[order], np.arange(len(part) + 1))
                running = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                parts.append((np.diff(edges), words, running[edges[1:]] - running[edges[:-1]]))
            columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_features", "n_words", "weight"])

    return weigh(F.col(text) if isinstance(text, str) else text)


def noise(seed: int, doc_id: str | Column = "doc_id") -> Column:
    """Gumbel noise of an id in floored thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, row_key, n_features, n_words, weight, score), one row per row of ``docs``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), weighed(gain).alias("w"))
    return rows.select("doc_id", "row_key", "w.*").withColumn("score", F.col("weight") + noise(seed))


def drawn(rows: DataFrame, share: Callable[[int], int]) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3, ... in falling score for the ``share(n)`` highest of the ``n`` rows with enough words, else null.

    Ranges of the score are numbered inside, plus the sizes of the ranges before.
    """
    kept = durable(rows)
    enough = F.col("n_words") >= LEAST_WORDS
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row_key")]
    ranged = durable(kept.where(enough).select("doc_id", "row_key", "n_features", "weight", "score").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per range
    total = sizes.agg(F.sum("n")).first()[0] or 0
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.join(before, "_range").withColumn("rank", F.when(place <= share(total), place).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(kept.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row, ``percent`` of those with enough words drawn towards ``target``."""
    return drawn(scored(docs, target, seed), lambda n: percent * n // 100)
