"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

**Word vectors.** A word is a run of letters and digits or a run of other visible characters, as
written. It is hashed to one of ``2 ** BITS`` buckets. Every bucket owns a fixed sparse
index vector (``NONZERO`` entries of 1 or -1 out of ``SIZE``); its word vector
is the sum of the index vectors of the words around it, over every whole
text of the corpus. Tasks add up in numpy, the sums meet by bucket; the table
sent to the tasks has at most ``2 ** BITS`` rows whatever the corpus.

**Pooling.** A text's vector is the mean of its words' unit vectors, rare and frequent words weighted alike
within a text, with the mean of the index vectors themselves beside it. The network sees nothing else.

**Network.** Standardised inputs, one hidden tanh layer, fitted in numpy by Adam on a bounded
sample of labelled rows (``MAX_ROWS``, the least by a hash of the id). A fifth of the sample is kept
aside and fits the temperature that calibrates the probabilities.

Null and empty texts pool to zeros and are scored like any other. Repeated rows count as often as they occur
and are all scored. Of labelled rows that share an id at the sample's edge any may be taken: they tie in the hash. Without labels of both kinds
the score is the share of ones, 0.5 if there are none. Columns other than the id, the text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import packed, sized, sized_batches, splitmix, stream

BITS = 14
SIZE = 32
NONZERO = 4
AROUND = 2
POOLED = 2 * SIZE
#: Labelled rows that the fit uses at most.
MAX_ROWS = 8000
HIDDEN = 32
STEPS, LOT, RATE, DECAY = 1500, 256, 3e-3, 1e-3

_BYTE = stream(256, 10)
_kind = np.full(256, 2, np.uint8)  # other visible characters
_kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_kind[48:58] = _kind[65:91] = _kind[97:123] = _kind[128:] = 1

_draws = stream((1 << BITS) * NONZERO, 12).reshape(-1, NONZERO)
#: Where the index vectors' entries are, and their signs.
PLACES = (_draws % np.uint64(SIZE)).astype(np.int64)
SIGNS = np.where((_draws >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


class Model(NamedTuple):
    words: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word in order, and each text's first word (one more entry for the end)."""
    data, offsets = packed(texts)
    kind = _kind[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    length = np.diff(np.append(begin, len(data)))
    power = np.full(int(length.max()), np.uint64(0xD1342543DE82EF95))
    power[0] = 1
    place = np.arange(len(data)) - np.repeat(begin, length)
    sums = np.add.reduceat(_BYTE[data] * np.cumprod(power)[place], begin)
    visible = kind[begin] > 0
    buckets = (splitmix(sums[visible] + length[visible].astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
    return buckets, np.searchsorted(begin[visible], offsets)


def context_sums(texts: pa.Array, total: np.ndarray) -> None:
    """Adds the index vectors around every word of the texts to ``total`` (buckets x SIZE, flat)."""
    words, first = _buckets(texts)
    whose = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in range(1, AROUND + 1):
        same = whose[:-d] == whose[d:]
        left, right = words[:-d][same], words[d:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * SIZE + PLACES[b, k], SIGNS[b, k], len(total))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets, from every whole text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE << BITS)
        for batch in sized_batches(batches, "text"):
            context_sums(batch.column("text"), total)
        rows = total.reshape(-1, SIZE)
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(c) for c in rows[seen].T.astype(np.int64))], names=["bucket", *names])

    names = [f"v{k}" for k in range(SIZE)]
    sums = docs.select("text").mapInArrow(gather, "bucket long, " + ", ".join(f"{n} long" for n in names))
    table = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((1 << BITS, SIZE))
    out[table.column("bucket").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """One vector per text."""
    found, first = _buckets(texts)
    n = np.diff(first)
    out = np.zeros((len(n), POOLED))
    some = n > 0
    if some.any():
        index = np.zeros((1 << BITS, SIZE), np.float32)
        for k in range(NONZERO):
            np.add.at(index, (np.arange(1 << BITS), PLACES[:, k]), SIGNS[:, k])
        both = np.concatenate([words, index], axis=1)
        out[some] = np.add.reduceat(both[found], first[:-1][some], axis=0) / n[some, None]
    return out


def _forward(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], float]:
    """(centre, scale, layers, temperature)."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        bias = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        d = x.shape[1]
        return np.zeros(d), np.ones(d), (np.zeros((d, 1)), np.zeros(1), np.zeros(1), np.array([bias])), 1.0
    aside = np.arange(len(y)) % 5 == 0
    centre, scale = x[~aside].mean(0), x[~aside].std(0) + 1e-6
    z = (x - centre) / scale
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    zt, yt = z[~aside], y[~aside]
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(yt), LOT)
        xb, yb = zt[pick], yt[pick]
        hidden, logit = _forward(xb, tuple(layers))
        g = (_sigmoid(logit) - yb) / LOT
        back = np.outer(g, layers[2]) * (1 - hidden**2)
        grads = [xb.T @ back + DECAY * layers[0], back.sum(0), hidden.T @ g + DECAY * layers[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    _, logit = _forward(z[aside], tuple(layers))
    choices = np.exp(np.linspace(np.log(0.2), np.log(10), 80))
    loss = [np.mean(np.logaddexp(0, logit / t) - y[aside] * logit / t) for t in choices]
    return centre, scale, tuple(layers), float(choices[int(np.argmin(loss))])


def sample_vectors(docs: DataFrame, labels: DataFrame, label: str, words: np.ndarray, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(9)).alias("_order"))
    chosen = chosen.orderBy("_order").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            x = pooled(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("_order"), pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "at", "x"])

    found = sorted(((r.at, r.y, bytes(r.x)) for r in rows.select("_y", "_order", "text").mapInArrow(vectors, "y int, at long, x binary").collect()))
    x = np.array([np.frombuffer(v, np.float64) for _, _, v in found]).reshape(-1, POOLED)
    return x, np.array([y for _, y, _ in found], np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Word vectors from all of ``docs``, the network from the labelled rows."""
    words = word_vectors(docs)
    return Model(words, *train(*sample_vectors(docs, labels, label, words, max_rows)))


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    return _sigmoid(_forward((x - model.centre) / model.scale, model.layers)[1] / model.temperature)


def score(model: Model, text: str | Column = "text") -> Column:
    """The calibrated probability of label 1 for a text column."""
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([predict(model, pooled(part, model.words)) for part in sized(texts)] or [np.zeros(0)]), pa.float64())

    return scored(F.col(text) if isinstance(text, str) else text)
