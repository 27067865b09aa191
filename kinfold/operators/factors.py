"""Rows of a group condensed to one triangular factor, whatever the group's size.

A vector ``x`` with an optional target ``y`` is extended to ``z = (1, x, y)``. The QR
factor ``R`` of a group's rows has ``RᵀR = Σ z zᵀ``; its first row gives the mean and
the block below it is the factor of the centred rows. Factors of parts are stacked and
factored again (tall-skinny QR: Demmel, Grigori, Hoemmen, Langou, 2012). A factor never
has more rows than its part, so what moves is bounded by the rows themselves and not by
groups times squared width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import durable

BLOCK_ROWS = 4096
FAN = 8
_FLUSH_BYTES = 256 << 20


def condense(z: np.ndarray) -> np.ndarray:
    """The factor of stacked rows or factors: at most as many rows as columns."""
    return np.linalg.qr(z, mode="r")


def centred(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, factor of the centred rows) of a factor of rows ``(1, x)``."""
    return r[0, 1:] / r[0, 0], r[1:, 1:]


def usable(df: DataFrame, *, key: str, vec: str, target: str | None = None) -> DataFrame:
    """Rows with a key and, where given, a target, whose vector holds finite numbers only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.col(key).isNotNull() & F.col(vec).isNotNull() & F.forall(vec, lambda v: finite(v.cast("double")))
    return df.where(whole & finite(F.col(target).cast("double")) if target else whole)


def group_factors(
    df: DataFrame,
    *,
    key: str,
    vec: str,
    finish: Callable[[int, np.ndarray], tuple | None],
    fields: str,
    target: str | None = None,
    min_rows: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, *fields): ``finish(rows, factor)`` of every group with at least ``min_rows`` rows.

    A group of up to ``block_rows`` rows is factored in one task. The tasks that read a larger
    group's rows condense them before the shuffle and deal the parts to blocks, which merge
    ``FAN`` at a time, so no task holds more than a block or ``FAN`` factors. ``finish`` may
    return None for a group without a result. Rows with a null key, a null target, or a vector
    that is null or holds a null, NaN or infinite component take no part and are not counted;
    a table without other rows gives an empty result.
    """
    z = F.concat(F.array(F.lit(1.0)), F.col(vec).cast("array<double>"), *([F.array(F.col(target).cast("double"))] if target else []))
    rows = usable(df, key=key, vec=vec, target=target).select(F.col(key).alias("_k"), z.alias("_z"))
    sizes = durable(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows))
    kind = df.select(key).schema[0].dataType.simpleString()
    result = f"`{key}` {kind}, {fields}"
    names = [key, *[f.split()[0].strip("`") for f in fields.split(",")]]

    def solve(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = finish(int(pdf["_m"].sum()), condense(np.stack(pdf["_z"].to_numpy())))
        return pd.DataFrame([] if out is None else [[k[0], *out]], columns=names, dtype=object)

    small = rows.join(sizes.where(F.col("_n") <= block_rows), "_k").select("_k", F.lit(1).alias("_m"), "_z")
    done = small.groupBy("_k").applyInPandas(solve, result)
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= block_rows:
        return done

    shape = f"_k {kind}, _b long, _m long, _z array<double>"

    def frame(k, b, m: int, r: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"_k": [k] * len(r), "_b": b, "_m": [m] + [0] * (len(r) - 1), "_z": list(r)})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for (k, b), part in pdf.groupby(["_k", "_b"], sort=False):
                add = np.stack(part["_z"].to_numpy())
                m, r = held.get((k, b), (0, add[:0]))
                r = np.vstack([r, add])
                held[k, b] = (m + len(add), condense(r) if len(r) > 2 * r.shape[1] else r)
            if sum(r.nbytes for _, r in held.values()) > _FLUSH_BYTES:
                yield from (frame(k, b, m, r) for (k, b), (m, r) in held.items())
                held = {}
        yield from (frame(k, b, m, r) for (k, b), (m, r) in held.items())

    def merge(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(k[0], k[1], int(pdf["_m"].sum()), condense(np.stack(pdf["_z"].to_numpy())))

    blocks = F.ceil(F.col("_n") / block_rows)
    large = rows.join(sizes.where(F.col("_n") > block_rows), "_k")
    parts = large.select("_k", F.pmod(F.xxhash64(F.spark_partition_id()), blocks).alias("_b"), "_z").mapInPandas(pack, shape)
    left = -(-largest // block_rows)
    while left > 1:
        parts = parts.groupBy("_k", "_b").applyInPandas(merge, shape).withColumn("_b", F.floor(F.col("_b") / FAN))
        left = -(-left // FAN)
    return done.unionByName(parts.groupBy("_k").applyInPandas(solve, result))
