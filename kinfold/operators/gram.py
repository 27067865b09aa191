"""Second-moment sums of vector columns, per key, in one pass.

A vector ``x`` with an optional target ``y`` is extended to ``z = (1, x, y)``; the
sums of ``z zᵀ`` hold counts, means, cross products and target products at once.
They merge, so training sums are the total minus the held-out part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 2048
_FLUSH_BYTES = 256 << 20


def vector_sum(column: str):
    """Element-wise sum of an ``array<double>`` column as an aggregate."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def vector_mean(column: str):
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column))))


def gram_rows(df: DataFrame, *, key: str, vec: str, target: str | None = None) -> DataFrame:
    """(key, i, row): row ``i`` of the summed ``z zᵀ`` of every key.

    Each task adds up its own rows and hands on at most one matrix per key (flushed
    early when many keys meet in one task); rows of the matrices, not whole
    matrices, are then summed, so no reducer holds more than vectors.
    """
    cols = [F.col(key).alias("_k"), F.col(vec).alias("_x")]
    if target:
        cols.append(F.col(target).cast("double").alias("_y"))
    key_type = df.select(key).schema[0].dataType.simpleString()

    def emit(sums: dict) -> Iterator[pd.DataFrame]:
        for k, m in sums.items():
            yield pd.DataFrame({key: [k] * len(m), "i": np.arange(len(m), dtype="int32"), "part": list(m)})

    def add(batches):
        sums: dict = {}
        used = 0
        for pdf in batches:
            for k, part in pdf.groupby("_k", sort=False):
                x = np.stack(part["_x"].to_numpy()).astype("float64")
                z = [np.ones((len(x), 1)), x]
                if target:
                    z.append(part["_y"].to_numpy(dtype="float64")[:, None])
                z = np.hstack(z)
                if k in sums:
                    sums[k] += z.T @ z
                else:
                    sums[k] = z.T @ z
                    used += sums[k].nbytes
            if used > _FLUSH_BYTES:
                yield from emit(sums)
                sums, used = {}, 0
        yield from emit(sums)

    parts = df.select(*cols).mapInPandas(add, f"`{key}` {key_type}, i int, part array<double>")
    return parts.groupBy(key, "i").agg(vector_sum("part").alias("row"))


def collect_gram(rows: DataFrame, *, key: str) -> dict:
    """Matrices per key on the driver. Their size depends on the vector length only; keys are folds."""
    out: dict = {}
    for k, i, row in rows.select(key, "i", "row").toLocalIterator():
        if len(row) > MAX_DIM + 2:
            raise ValueError(f"vectors longer than {MAX_DIM} need a reduced basis first")
        out.setdefault(k, {})[i] = row
    return {k: np.array([m[i] for i in range(len(m))]) for k, m in out.items()}


def ridge_from_gram(g: np.ndarray, alpha: float, *, standard: bool = True, eps: float = 0.0):
    """(weights, intercept) on the raw scale from ``z zᵀ`` of the training rows.

    With ``standard`` the penalty acts on columns scaled by their population
    deviation; a constant column keeps scale one.
    """
    n = g[0, 0]
    d = len(g) - 2
    mean = g[0, 1 : d + 1] / n
    y_mean = g[0, -1] / n
    c = g[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
    b = g[1 : d + 1, -1] - n * mean * y_mean
    scale = np.ones(d)
    if standard:
        var = np.maximum(np.diag(c) / n, 0.0)
        flat = var <= 1e-12 * np.maximum(1.0, mean**2)
        scale = np.where(flat, 1.0, np.sqrt(var) + eps)
    c = c / np.outer(scale, scale)
    w = np.linalg.solve(c + alpha * np.eye(d), b / scale) / scale
    return w, float(y_mean - mean @ w)


def fold_moments(rows: DataFrame, *, key: str) -> dict:
    """{key: (n, sums, squares)} on the driver, without cross products."""
    out = {}
    for r in rows.collect():
        out[r[key]] = (r["n"], np.array(r["s"]), np.array(r["q"]))
    return out


def moments(df: DataFrame, *, key: str, vec: str) -> DataFrame:
    """Count, sum and sum of squares of a vector column per key."""
    sq = df.withColumn("_sq", F.transform(vec, lambda x: x * x))
    return sq.groupBy(key).agg(F.count("*").alias("n"), vector_sum(vec).alias("s"), vector_sum("_sq").alias("q"))
