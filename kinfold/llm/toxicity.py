"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, neighbouring pairs and pairs with one
word between them, hashed to ``2 ** BITS`` weights. FTRL-proximal keeps a learning
rate for each coordinate and sets small weights to exactly zero, so the model is a
short list of (index, weight), at most ``2 ** BITS`` long: the proven bound of what
is sent to the tasks. It is fitted on a bounded sample of labelled rows
(``MAX_ROWS``, the least by a hash of the id); every row is scored, on its whole text.

Null and empty texts have no features and get the score of the bias alone. Rows
whose label is null teach nothing; without any labels the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import sized, sized_batches, splitmix
from kinfold.llm.words import WORD_BYTES, hashed_words

BITS = 20
#: Labelled rows that the fit uses at most.
MAX_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0


class Weights(NamedTuple):
    bias: float
    index: np.ndarray
    weight: np.ndarray


def _features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Indices of every feature occurrence of each text."""
    words, first = hashed_words(texts, WORD_BYTES)
    shift = np.uint64(64 - BITS)
    mixed = words * np.uint64(0x9FB21C651E98DF25)
    pairs = [splitmix(mixed[:-d] + words[d:] + np.uint64(d)) >> shift for d in (1, 2)]
    single = words >> shift
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.concatenate([single[a:b], *(p[a : max(a, b - d)] for d, p in enumerate(pairs, 1))])


def sample_features(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(label, order, features) of at most ``max_rows`` labelled rows."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)).alias("_order"))
    chosen = chosen.orderBy("_order").limit(max_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            lists = [np.unique(f).astype(np.int32) for f in _features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("_order"), pa.array([x.tobytes() for x in lists], pa.binary())], names=["y", "at", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids
    return rows.select("_y", "_order", "text").mapInArrow(featured, "y int, at long, features binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Weights:
    """FTRL-proximal over the sample, each document one step; the order of steps is that of the id hash."""
    sample = sorted(((r.at, r.y, np.frombuffer(r.features, np.int32)) for r in sample_features(docs, labels, label, max_rows).collect()), key=lambda r: (r[0], r[1]))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    if not sample:
        return Weights(-np.inf, np.zeros(0, np.int32), np.zeros(0))
    for _ in range(EPOCHS):
        for _, y, x in sample:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            b = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35))) - y
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            bz, bn = bz + g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA * b, bn + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    index = np.flatnonzero(w).astype(np.int32)
    return Weights(float(-bz / ((BETA + np.sqrt(bn)) / ALPHA)), index, w[index])


def score(weights: Weights, text: str | Column = "text") -> Column:
    """The probability of label 1 for a text column."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << BITS)
        dense[weights.index] = weights.weight
        for texts in batches:
            out = []
            for part in sized(texts):
                for x in _features(part):
                    x = x[dense[x] != 0]
                    sum_ = weights.bias + dense[np.unique(x)].sum()
                    out.append(1 / (1 + np.exp(-np.clip(sum_, -500, 500))) if np.isfinite(sum_) else 0.0)
            yield pa.array(out, pa.float64())

    return scored(F.col(text) if isinstance(text, str) else text)
