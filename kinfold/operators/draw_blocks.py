"""Statistics of all draws from rows that no draw moves.

A draw says how often each cluster counts. Rows are packed once, each as the number of its cluster and what the statistic needs, and a
task takes a block of draws: it hashes the places of its own draws, holds one byte for each cluster and draw, and reads all packs from the
checkpoint. So nothing is shuffled or written for a draw, and disk holds some bytes for each row whatever the number of draws. Tasks number
about three times the cores; each reads every pack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.functions.hashing import LANES
from kinfold.functions.ranking import value_bucket
from kinfold.operators.many_draws import hit_numbers
from kinfold.session import durable

PACK = 1 << 16  # rows of a pack
HELD = 1 << 27  # bytes of multiplicities in a task
RANKED = 1 << 24  # rows that a task ranks at once; a larger key goes by draw_ranks
STRATA = 1 << 16  # strata whose sizes every task gets
_KEPT = 1 << 22  # rows that a task holds before it hands on packs that are not full
_TARGET = 1 << 40  # above every number of a cluster
EVERY = -1  # the draw in which each cluster counts once


class Blocks:
    """The draws of ``many_draws.hit_bytes``, dealt out in blocks; ``units`` gives every cluster its number."""

    def __init__(self, units: DataFrame, strata: Sequence[tuple[str, int, int]], n_draws: int, seed: int | str):
        self.units, self.strata, self.n_draws, self.seed = units, list(strata), n_draws, seed
        self.n = sum(size for _, size, _ in self.strata)
        fits = max(1, HELD // max(self.n, 1))
        self.lane = next(w for w in (8, 4, 2, 1) if w <= fits)
        cores = max(units.sparkSession.sparkContext.defaultParallelism, 4)
        each = min(fits, 64, -(-n_draws // (3 * cores)))
        self.each = max(1, each // self.lane) * self.lane

    def scanned(self, packs: DataFrame, scan: Callable, schema: str) -> DataFrame:
        """``scan(draws, batches, multiplicities)`` over all packs for every block of draws; ``EVERY`` is one more draw."""
        strata, n, seed, lane = self.strata, self.n, self.seed, self.lane

        def task(draws: range) -> Callable:
            return lambda batches: scan(draws, batches, multiplicities(draws, strata, n, seed, lane))

        starts = range(EVERY, self.n_draws, self.each)
        parts = [packs.coalesce(1).mapInArrow(task(range(i, min(i + self.each, self.n_draws))), schema) for i in starts]
        none = packs.sparkSession.range(0, 2, 1, 2).mapInArrow(lambda batches: iter(()), schema)  # without it Spark joins parts of one partition into one task
        return reduce(DataFrame.unionAll, parts, none)


def blocks(numbered: DataFrame, *, cluster: str, n_draws: int, seed: int | str) -> Blocks | None:
    """From clusters with ``_stratum``, ``_index`` and ``_size``; none where there are too many strata."""
    sizes = numbered.groupBy("_stratum").agg(F.max(F.col("_size").cast("long")).alias("n")).limit(STRATA + 1).collect()
    if len(sizes) > STRATA or not sizes or sum(r["n"] for r in sizes) >= 1 << 31:
        return None
    strata, first = [], 0
    for r in sorted(sizes, key=lambda r: r["_stratum"]):
        strata.append((r["_stratum"], r["n"], first))
        first += r["n"]
    if len(strata) == 1:
        units = numbered.select(cluster, F.col("_index").cast("long").alias("_unit"))
    else:
        at = numbered.sparkSession.createDataFrame([(s, f) for s, _, f in strata], "_stratum string, _first long")
        units = numbered.join(at, "_stratum").select(cluster, (F.col("_index") + F.col("_first")).alias("_unit"))
    return Blocks(units, strata, n_draws, seed)


def multiplicities(draws: range, strata: Sequence[tuple[str, int, int]], n: int, seed: int | str, lane: int) -> np.ndarray:
    """How often every cluster counts: (group of ``lane`` draws, cluster, draw), one byte each."""
    out = np.zeros((-(-len(draws) // lane), n, lane), np.uint8)
    lead = f"{seed}|".encode()
    if EVERY in draws:
        out[0, :, 0] = 1
    hashed = range(max(draws.start, 0), draws.stop)
    for label, size, first in strata:
        some = 1 if size > LANES else max(1, (1 << 22) // size)
        for b in range(hashed.start, hashed.stop, some):
            part = range(b, min(b + some, hashed.stop))
            counts = np.zeros((len(part), size), np.uint16)
            for own, hits in hit_numbers(lead, label, size, 0, size, part):
                np.add.at(counts.reshape(-1), ((own - b)[:, None] * size + hits).ravel(), np.uint16(1))
            if counts.max() > 255:
                raise ValueError("a unit was drawn more than 255 times")
            for i, c in zip(part, counts):
                at = i - draws.start
                out[at // lane, first : first + size, at % lane] = c
    return out


def _drawn(held: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Multiplicities of the rows, one line for each draw of a group."""
    lane = held.shape[1]
    whole = held.view(f"u{lane}").reshape(-1)
    return np.ascontiguousarray(whole.take(units).view(np.uint8).reshape(len(units), lane).T)


def _bytes_at(column: pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _shape(df: DataFrame, keys: Sequence[str]) -> tuple[str, dict]:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys), {k: to_arrow_type(df.schema[k].dataType) for k in keys}


def packed(rows: DataFrame, *, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """(keys, columns): up to ``PACK`` rows of a key as one row, each column as the bytes of an array of its numpy type."""
    shape, kinds = _shape(rows, keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kept = 0

        def hand_on(key: tuple, parts: list) -> pa.RecordBatch:
            whole = [pa.array([np.concatenate(p).tobytes()], pa.binary()) for p in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.array([v], kinds[k]) for k, v in zip(keys, key, strict=True)), *whole], names=[*keys, *columns])

        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                own, values = pd.factorize(batch.column(k).to_pandas(), use_na_sentinel=False)
                code = np.unique(code * len(values) + own, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True]) if len(order) else []
            arrays = [batch.column(c).to_numpy(zero_copy_only=False).astype(t)[order] for c, t in columns.items()]
            for a, z in zip(cuts, cuts[1:]):
                key = tuple(batch.column(k)[int(order[a])].as_py() for k in keys)
                parts, size = held.pop(key, ([], 0))
                parts.append([x[a:z] for x in arrays])
                kept += z - a
                if size + z - a >= PACK:
                    yield hand_on(key, parts)
                    kept -= size + z - a
                else:
                    held[key] = (parts, size + z - a)
            while kept > _KEPT:
                key = next(iter(held))  # the one not met for the longest time
                parts, size = held.pop(key)
                kept -= size
                yield hand_on(key, parts)
        for key, (parts, _) in held.items():
            yield hand_on(key, parts)

    return rows.select(*keys, *columns).mapInArrow(pack, shape + ", ".join(f"{c} binary" for c in columns))


def weights_by_draw(rows: DataFrame, draws: Blocks, *, cluster: str, keys: Sequence[str]) -> DataFrame:
    """(keys, boot, _w): the number of rows of every key in every draw; a key without a row in a draw is missing there."""
    keys = list(keys)
    packs = durable(packed(rows.join(draws.units, cluster), keys=keys, columns={"_unit": "int32"}))
    shape, kinds = _shape(packs, keys)

    def scan(own: range, batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in keys)
                total = sums.setdefault(key, np.zeros((len(held), held.shape[2]), np.int64))
                units = _bytes_at(batch.column("_unit"), i, np.int32)
                for g, part in enumerate(held):
                    total[g] += _drawn(part, units).sum(axis=1, dtype=np.int64)
        for key, total in sums.items():
            w = total.ravel()[: len(own)]
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(own), kinds[k]) for k, v in zip(keys, key, strict=True)), pa.array(np.arange(own.start, own.stop), pa.int32()), pa.array(w.astype(float))], names=[*keys, "boot", "_w"])

    return draws.scanned(packs, scan, shape + "boot int, _w double").where("_w > 0")


def ordered_packs(rows: DataFrame, *, keys: Sequence[str], score: str, target: str, step: int = 128) -> DataFrame:
    """(keys, _first, _single, _units, _bounds): rows of a key in the order of their scores, as runs of equal scores with negatives first.

    ``_bounds`` has, for the runs with a positive row, their starts, their first positive rows and their ends. A run never lies in two packs,
    but one of more than ``PACK`` rows, whose packs are marked ``_single``.
    """
    shape, kinds = _shape(rows, keys)
    positive = (F.col(target) == 1).cast("long") * _TARGET
    bucket = F.floor(value_bucket(score) / step)
    cut = rows.where(F.col(score).isNotNull()).select(*keys, bucket.alias("_b"), F.col(score).cast("double").alias("_s"), (F.coalesce(positive, F.lit(0)) + F.col("_unit")).alias("_c"))
    ordered = cut.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", "_s", "_c")
    group = [*keys, "_b"]

    def record(key: tuple, s: np.ndarray, c: np.ndarray, single: bool) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        end = np.r_[start[1:], len(s)]
        count = np.add.reduceat((c >= _TARGET).astype(np.int64), start)
        some = count > 0
        bounds = np.concatenate([start[some], (end - count)[some], end[some]]).astype(np.int32)
        arrays = [pa.array([s[0]]), pa.array([single]), pa.array([(c % _TARGET).astype(np.int32).tobytes()], pa.binary()), pa.array([bounds.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array([v], kinds[k]) for k, v in zip(keys, key)), *arrays], names=[*keys, "_first", "_single", "_units", "_bounds"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, open_run = None, [], 0, None

        def hand_on(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, open_run
            s, c = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            at = 0
            while at < len(s) and (last or len(s) - at > PACK):
                ahead = first[np.searchsorted(first, at, "right") :]
                run = int(ahead[0]) if len(ahead) else len(s)
                if s[at] == open_run or run - at > PACK:
                    open_run = s[at]
                    for i in range(at, run, PACK):
                        yield record(key, s[i : min(i + PACK, run)], c[i : min(i + PACK, run)], True)
                    at = run
                    continue
                if last and len(s) - at <= PACK:
                    to = len(s)
                else:
                    to = int(ahead[np.searchsorted(ahead, at + PACK, "right") - 1])
                yield record(key, s[at:to], c[at:to], False)
                at = to
            held, size = ([(s[at:], c[at:])] if at < len(s) else []), len(s) - at
            if last:
                open_run = None

        for batch in batches:
            s, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("_s", "_c"))
            turn = np.zeros(batch.num_rows + 1, bool)
            turn[[0, -1]] = True
            for k in group:
                own = pd.factorize(batch.column(k).to_pandas(), use_na_sentinel=False)[0]
                turn[1:-1] |= own[1:] != own[:-1]
            cuts = np.flatnonzero(turn)
            for a, z in zip(cuts, cuts[1:]):
                now = tuple(batch.column(k)[int(a)].as_py() for k in group)
                if now != key and held:
                    yield from hand_on(True)
                key, open_run = now, open_run if now == key else None
                held.append((s[a:z], c[a:z]))
                size += z - a
                if size >= 2 * PACK:
                    yield from hand_on(False)
        if held:
            yield from hand_on(True)

    return ordered.mapInArrow(pack, shape + "_first double, _single boolean, _units binary, _bounds binary")


def auroc_by_block(rows: DataFrame, draws: Blocks, *, cluster: str, keys: Sequence[str], score: str, target: str) -> DataFrame:
    """(keys, boot, auroc) of rows with a 0/1 target; null where a draw lacks one of the classes.

    With ``S`` and ``E`` the number of rows before and up to a run, in a draw, a run's positive rows stand above half of ``S + E`` rows; of these
    the positive ones are half of all their pairs.
    """
    keys = list(keys)
    packs = durable(ordered_packs(rows.join(draws.units, cluster), keys=keys, score=score, target=target, step=128 if draws.n > 100_000 else 8192))
    shape, kinds = _shape(packs, keys)

    def scan(own: range, batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        lane = held.shape[2]
        for batch in batches:
            for i in range(batch.num_rows):
                units, bounds = _bytes_at(batch.column("_units"), i, np.int32), _bytes_at(batch.column("_bounds"), i, np.int32).reshape(3, -1)
                p, t, u = np.zeros((3, len(held), lane))
                running = np.zeros((lane, len(units) + 1), np.int32)
                for g, part in enumerate(held):
                    np.cumsum(_drawn(part, units), axis=1, dtype=np.int32, out=running[:, 1:])
                    t[g] = running[:, -1]
                    if bounds.shape[1]:
                        start, middle, end = (running.take(b, axis=1) for b in bounds)
                        np.subtract(end, middle, out=middle)
                        start += end
                        p[g] = middle.sum(axis=1)
                        u[g] = np.einsum("ij,ij->i", middle.astype(float), start.astype(float)) / 2
                single = batch.column("_single")[i].as_py()
                key = tuple(batch.column(k)[i].as_py() for k in keys)
                found.setdefault(key, []).append((batch.column("_first")[i].as_py(), single, p.ravel(), (t - p).ravel(), (u - p * p / 2).ravel()))
        for key, parts in found.items():
            positive, below, wins = np.zeros((3, len(held) * lane))
            parts.sort(key=lambda x: x[0])
            at = 0
            while at < len(parts):
                first, single, p, q, u = parts[at]
                to = at + 1
                if single:  # the packs of one run
                    while to < len(parts) and parts[to][0] == first:
                        p, q, to = p + parts[to][2], q + parts[to][3], to + 1
                    u = p * q / 2
                wins += u + p * below
                positive += p
                below += q
                at = to
            with np.errstate(invalid="ignore", divide="ignore"):
                auroc = (wins / (positive * below))[: len(own)]
            lacking = ((positive == 0) | (below == 0))[: len(own)]
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(own), kinds[k]) for k, v in zip(keys, key, strict=True)), pa.array(np.arange(own.start, own.stop), pa.int32()), pa.array(auroc, mask=lacking)], names=[*keys, "boot", "auroc"])

    return draws.scanned(packs, scan, shape + "boot int, auroc double")


def _runs(v: np.ndarray) -> np.ndarray:
    """Starts of the runs of ordered values, and their number of rows at the end."""
    new = v[1:] != v[:-1]
    if len(v) and np.isnan(v[-1]):
        new &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    return np.r_[0, np.flatnonzero(new) + 1, len(v)].astype(np.int32)


def _correlations(units: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of rows, rank correlation or none) of one key in all draws."""
    rows, lane = len(units), min(held.shape[2], 4)
    order = np.argsort(x)
    xs = _runs(x[order])
    units, y = units[order], y[order]
    order = np.argsort(y)
    ys = _runs(y[order])
    del x, y
    run = np.empty(rows, np.int32)
    run[order] = np.repeat(np.arange(len(ys) - 1, dtype=np.int32), np.diff(ys))
    by_y = units[order]
    del order
    edges = np.unique(np.r_[np.searchsorted(xs, np.arange(0, rows, PACK)), len(xs) - 1])  # runs of x that are taken together
    counts, rho = np.zeros(len(held) * held.shape[2]), np.full(len(held) * held.shape[2], np.nan)
    running = np.zeros((lane, rows + 1), np.int32)

    def fill(part: np.ndarray, of: np.ndarray) -> None:
        before = np.zeros((lane, 1), np.int64)
        for i in range(0, rows, PACK):
            here = running[:, i + 1 : i + 1 + PACK]
            np.cumsum(_drawn(part, of[i : i + PACK]), axis=1, dtype=np.int32, out=here)
            here += before.astype(np.int32)
            before = here[:, -1:].astype(np.int64)
            if before.max() >= 1 << 30:
                raise ValueError("too many rows of one key in a draw")

    for g, whole in enumerate(held):
        for j in range(0, whole.shape[1], lane):
            part = np.ascontiguousarray(whole[:, j : j + lane])
            fill(part, by_y)
            totals, squares, ranks = running[:, -1].astype(float), np.zeros(lane), []
            for d in range(lane):  # ranks are doubled and centred
                up = running[d].take(ys)
                rank = up[1:] + up[:-1]
                rank -= running[d, -1]
                for i in range(0, len(rank), PACK):
                    squares[d] += np.einsum("i,i,i->", np.diff(up[i : i + PACK + 1]).astype(float), rank[i : i + PACK].astype(float), rank[i : i + PACK].astype(float))
                ranks.append(rank)
            fill(part, units)
            for d in range(lane):
                both, own = 0.0, 0.0
                for a, z in zip(edges, edges[1:]):
                    lo, hi = xs[a], xs[z]
                    here = running[d, lo : hi + 1]
                    up = here if hi - lo == z - a else here.take(xs[a : z + 1] - lo)
                    rank = (up[1:] + up[:-1] - running[d, -1]).astype(float)
                    own += np.einsum("i,i,i->", np.diff(up).astype(float), rank, rank)
                    v = np.diff(here).astype(float)
                    v *= ranks[d].take(run[lo:hi])
                    both += v @ (rank if len(rank) == len(v) else np.repeat(rank, np.diff(xs[a : z + 1])))
                at = g * whole.shape[1] + j + d
                counts[at] = totals[d]
                least = totals[d] ** 3 * 1e-14  # what rounding leaves of a constant side; two values leave a square
                if own > least and squares[d] > least:
                    rho[at] = both / np.sqrt(own * squares[d])
    return counts, rho


def correlation_by_block(rows: DataFrame, draws: Blocks, *, cluster: str, keys: Sequence[str], x: str, y: str) -> DataFrame | None:
    """(keys, boot, rho); draws in which a key has no row are missing. None where a key has more rows than ``RANKED``.

    A task holds the rows of one key at a time, ordered once for its draws: some 25 bytes a row beside the multiplicities.
    """
    keys = list(keys)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(draws.units, cluster)
    loose = packed(both.select(*keys, "_unit", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), keys=keys, columns={"_unit": "int32", "_x": "float64", "_y": "float64"})
    packs = durable(loose.repartition(*keys).sortWithinPartitions(*keys))  # the packs of a key lie together
    largest = packs.groupBy(*keys).agg(F.sum(F.length("_unit") / 4).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > RANKED:
        return None
    shape, kinds = _shape(packs, keys)
    names = [*keys, "boot", "rho"]

    def scan(own: range, batches: Iterator[pa.RecordBatch], held: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def score() -> pa.RecordBatch:
            arrays = [np.concatenate([np.frombuffer(p.pop(0), t) for p in parts]) for t in (np.int32, np.float64, np.float64)]
            parts.clear()
            n, rho = (v[: len(own)] for v in _correlations(*arrays, held))
            some = n > 0
            boot = np.arange(own.start, own.stop)[some]
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(boot), kinds[k]) for k, v in zip(keys, key, strict=True)), pa.array(boot, pa.int32()), pa.array(rho[some], mask=np.isnan(rho[some]))], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                now = tuple(batch.column(k)[i].as_py() for k in keys)
                if now != key and parts:
                    yield score()
                key = now
                parts.append([batch.column(c)[i].as_py() for c in ("_unit", "_x", "_y")])
        if parts:
            yield score()

    return draws.scanned(packs, scan, shape + "boot int, rho double")
