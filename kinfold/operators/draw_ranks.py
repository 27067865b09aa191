"""Rank correlation under many draws at once.

A cell carries its multiplicities under all draws as one byte each. Both sides are cut at quantiles, so that a bucket is a
range of about ``ROWS`` cells, and a value as frequent as that is a bucket of its own, which is dealt out further: its
cells share one rank. The first pass ranks a bucket of ``y`` in all draws, knowing what lies below it; the second one
ranks a bucket of ``x`` from its own start and multiplies. A later start adds to its sums as a number times a sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.many_draws import _bytes_of, draw_bytes
from kinfold.session import durable

ROWS = 1 << 14  # cells in a bucket; the bounds of buckets are on the driver
_AT_ONCE = 64  # draws whose ranks are in memory at a time
_SUMS = ("w", "a", "c", "d", "e", "f")


def _cuts(cells: DataFrame, keys: Sequence[str], sides: Sequence[str]) -> tuple[int, list[dict]]:
    """Number of buckets, and for each side the distinct quantiles of every key."""
    largest = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-largest // ROWS))
    if parts == 1:
        return 1, [{} for _ in sides]
    at = [i / parts for i in range(1, parts)]
    found = cells.groupBy(*keys).agg(*[F.percentile_approx(F.col(s).cast("double"), at, max(10000, 20 * parts)).alias(f"_c{i}") for i, s in enumerate(sides)]).collect()  # one row for each key
    return parts, [{tuple(r[k] for k in keys): np.unique(np.array(r[f"_c{i}"])) for r in found} for i in range(len(sides))]


def _bucketed(cells: DataFrame, keys: Sequence[str], sides: Sequence[str]) -> DataFrame:
    """``cells`` with the bucket (odd: one value) and the share of it, for each side."""
    parts, cuts = _cuts(cells, keys, sides)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            number = {name: i for i, name in enumerate(dict.fromkeys(names))}
            of = np.fromiter((number[name] for name in names), np.int64, len(names))
            out = []
            for side, known in zip(sides, cuts, strict=True):
                v, bucket = batch.column(side).cast(pa.float64()).to_numpy(), np.zeros(len(of), np.int32)
                for name, i in number.items():
                    bounds, own = known.get(name, np.zeros(0)), np.flatnonzero(of == i)
                    spot = np.searchsorted(bounds, v[own])
                    same = np.r_[bounds, np.nan][spot] == v[own]
                    bucket[own] = 2 * spot + same
                out.append(pa.array(bucket))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f"_b{i}" for i in range(len(sides)))])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + "".join(f", _b{i} int" for i in range(len(sides)))
    share = F.pmod(F.xxhash64(*cells.columns), F.lit(parts)).cast("int")
    placed = cells.mapInArrow(place, shape)
    return placed.withColumns({f"_s{i}": F.when(F.col(f"_b{i}") % 2 == 1, share).otherwise(0) for i in range(len(sides))})


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _ranks(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Twice the mid-rank less one of ordered values, each counted as often as its weight, in every column."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    own = np.add.reduceat(weights, first, axis=0)
    return np.repeat(2 * (np.cumsum(own, axis=0) - own) + own, np.diff(np.r_[first, len(values)]), axis=0)


def correlation_by_draw(cells: DataFrame, draws: DataFrame, *, cluster: str, keys: Sequence[str], x: str, y: str, n_draws: int) -> DataFrame:
    """(keys, boot, rho) for cells with the weight ``_w``; draws in which a key has no cell are missing."""
    keys = list(keys)
    both = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(cluster).alias("_cl"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col("_w").cast("long").alias("_w"))
    placed = durable(_bucketed(both, keys, ["_x", "_y"]))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    own = draw_bytes(draws, cluster=cluster, n_draws=n_draws).withColumnRenamed(cluster, "_cl")
    wide = placed.join(own, "_cl").drop("_cl")
    by_y, by_x = [*keys, "_b1", "_s1"], [*keys, "_b0", "_s0"]

    def shape(names: Sequence[str], more: str) -> str:
        return ", ".join(f"`{n}` {kinds[n]}" for n in names) + more

    def weigh(table: pa.Table, order: np.ndarray, m: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        w = _column(table, "_w").to_numpy()[order]
        for i in range(0, n_draws, _AT_ONCE):
            yield slice(i, i + _AT_ONCE), m[order, i : i + _AT_ONCE] * w[:, None]

    def total(table: pa.Table) -> pa.Table:
        m, every, out = _bytes_of(_column(table, "_m"), n_draws), np.arange(table.num_rows), np.zeros(n_draws)
        for at, w in weigh(table, every, m):
            out[at] = w.sum(axis=0)
        return pa.Table.from_arrays([*(table.column(k)[:1] for k in by_y), pa.array([out], pa.list_(pa.float64()))], names=[*by_y, "_t"])

    wide_y = wide.groupBy(*by_y)
    sums = wide_y.applyInArrow(total, shape(by_y, ", _t array<double>")).select(*by_y, F.posexplode("_t").alias("_d", "_t"))
    whole = Window.partitionBy(*keys, "_d")
    under = whole.orderBy("_b1").rangeBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by_y, F.struct("_d", F.coalesce(F.sum("_t").over(under), F.lit(0.0)).alias("u"), F.sum("_t").over(Window.partitionBy(*keys, "_d", "_b1")).alias("s"), F.sum("_t").over(whole).alias("n")).alias("_h"))
    heads = starts.groupBy(*by_y).agg(F.sort_array(F.collect_list("_h")).alias("_h")).select(*by_y, *[F.col(f"_h.{c}").alias(f"_h{c}") for c in "usn"])
    kept = [*keys, "_x", "_w", "_b0", "_s0"]

    def rank(table: pa.Table, head: pa.Table) -> pa.Table:
        names = [*kept, "_m", "_r"]
        if not table.num_rows:
            return pa.Table.from_arrays([*(table.column(c) for c in kept), pa.nulls(0, pa.binary()), pa.nulls(0, pa.binary())], names=names)
        below, same, every = (np.array(head.column(f"_h{c}")[0].as_py()).astype(np.int64) for c in "usn")
        values, m = _column(table, "_y").to_numpy(), _bytes_of(_column(table, "_m"), n_draws)
        order = np.argsort(values, kind="stable")
        ranks = np.empty(m.shape, np.int32 if every.max() < 1 << 31 else np.int64)
        single = table.column("_b1")[0].as_py() % 2 == 1
        for at, w in weigh(table, order, m):
            ranks[:, at] = (same[at] if single else _ranks(values[order], w)) + 2 * below[at] - every[at]
        m = m[order]
        hit = m > 0
        ends = np.r_[0, np.cumsum(hit.sum(axis=1))] * ranks.itemsize
        flat = ranks[hit].tobytes()
        del ranks
        table = table.take(pa.array(order))
        packed = pa.array([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.Table.from_arrays([*(table.column(c) for c in kept), pa.array([r.tobytes() for r in m], pa.binary()), packed], names=names)

    ranked = wide_y.cogroup(heads.groupBy(*by_y)).applyInArrow(rank, shape(kept, ", _m binary, _r binary"))

    def multiply(table: pa.Table) -> pa.Table:
        values, m = _column(table, "_x").to_numpy(), _bytes_of(_column(table, "_m"), n_draws)
        order, hit = np.argsort(values, kind="stable"), m > 0
        flat = b"".join(_column(table, "_r").to_pylist())
        ranks = np.zeros(m.shape, np.int32 if len(flat) == 4 * hit.sum() else np.int64)
        ranks[hit] = np.frombuffer(flat, ranks.dtype)
        out = np.zeros((len(_SUMS), n_draws))
        single = table.column("_b0")[0].as_py() % 2 == 1
        for at, w in weigh(table, order, m):
            v, r = w.astype(np.float64), ranks[order, at].astype(np.float64)
            p = np.zeros_like(v) if single else _ranks(values[order], w).astype(np.float64)
            vr, vp = v * r, v * p
            out[:, at] = v.sum(0), vr.sum(0), np.einsum("ij,ij->j", vr, p), vp.sum(0), np.einsum("ij,ij->j", vp, p), np.einsum("ij,ij->j", vr, r)
        return pa.Table.from_arrays([*(table.column(k)[:1] for k in by_x), *(pa.array([v], pa.list_(pa.float64())) for v in out)], names=[*by_x, *_SUMS])

    parts = ranked.groupBy(*by_x).applyInArrow(multiply, shape(by_x, "".join(f", {s} array<double>" for s in _SUMS)))
    long = parts.select(*keys, "_b0", F.posexplode(F.arrays_zip(*_SUMS)).alias("boot", "_z"))
    long = long.groupBy(*keys, "boot", "_b0").agg(*[F.sum(f"_z.{s}").alias(s) for s in _SUMS])
    whole = Window.partitionBy(*keys, "boot")
    lower = F.coalesce(F.sum("w").over(whole.orderBy("_b0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = 2 * lower + F.when(F.col("_b0") % 2 == 1, F.col("w")).otherwise(0.0) - F.sum("w").over(whole)
    moved = long.withColumn("_at", start)
    at = F.col("_at")
    g = moved.groupBy(*keys, "boot").agg(
        F.sum("w").alias("_n"), F.sum(at * F.col("a") + F.col("c")).alias("_c"), F.sum("f").alias("_vy"),
        F.sum(at * at * F.col("w") + 2 * at * F.col("d") + F.col("e")).alias("_vx"),
    )
    least = F.pow("_n", F.lit(3)) * 1e-14  # what rounding leaves of a constant side; two values leave a square
    rho = F.when((F.col("_vx") > least) & (F.col("_vy") > least), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy")))
    return g.where("_n > 0").select(*keys, "boot", rho.alias("rho"))
