"""Boosted trees that route nulls, grown from histograms for all folds and classes together.

Values are cut once into bins between quantiles of each fold's training side; a null (or NaN) has a bin of its own. A level of
all trees of a round is one job: tasks add up gradient, curvature and row count of every (fold, class, node, feature, bin), and the sums meet in a
shuffle as wide as the histograms, whatever the number of rows. Every cut is tried with the nulls on either
side, and also nulls against all other values; the better side is stored in the node, so nulls may go with low values in one node and with high
values in another. Where a node saw no null while growing, nulls follow its larger child.

No value is filled in. The leaves of the last level come from its own cuts, so a round costs ``depth`` jobs.
Scores of finished rounds are written back every ``REFRESH`` rounds, so a scan applies few trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.stacked import BLOCK, NONE, OUT, Problem, _lists, _matrix, _shares, _sums
from kinfold.session import durable

#: Rounds whose trees a scan applies to the written scores at most, the bin of nulls, and quantiles looked at for each bin.
REFRESH, NULL, FINE = 5, 255, 4
#: Rows that are worth a task of their own.
SPREAD = 1024


@dataclass(frozen=True)
class RoutedTrees:
    """Boosted trees with learned sides for nulls; takes vectors whose elements may be null."""

    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    min_rows: int = 20


class Tree(NamedTuple):
    """Nodes in heap order: feature (-1: leaf), bin and value of the cut, whether nulls go left, and the leaf's score."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, binned: bool, depth: int) -> np.ndarray:
        """Node of every row after ``depth`` levels, from bins or from values."""
        if binned:
            return self._binned_nodes(x, depth)
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            j = self.feature[at]
            v = x[rows, np.maximum(j, 0)]
            left = np.where(np.isnan(v), self.null_left[at], v <= self.cut[at])
            at = np.where(j < 0, at, 2 * at + np.where(left, 1, 2))
        return at

    def _binned_nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """A table has the next node for every node and bin, so that a level is three look-ups for a row."""
        node = np.arange(len(self.feature), dtype=np.int32)[:, None]
        left = np.arange(NULL + 1) <= self.bin[:, None]
        left[:, NULL] = self.null_left
        following = np.where(self.feature[:, None] < 0, node, 2 * node + np.where(left, 1, 2)).astype(np.int32).ravel()
        feature, flat = np.maximum(self.feature, 0), np.ascontiguousarray(x).ravel()
        first = np.arange(len(x)) * x.shape[1]
        at = np.zeros(len(x), np.int32)
        for _ in range(depth):
            at = following.take(at * (NULL + 1) + flat.take(first + feature.take(at)))
        return at.astype(np.int64)


def _seed(depth: int) -> Tree:
    n = 2 ** (depth + 1) - 1
    return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n))


@dataclass(frozen=True)
class Routed:
    """Fitted trees: ``rounds[r][problem][class]``, and the first scores of every problem."""

    problems: list
    first: list
    rounds: list
    depth: int
    n_classes: int

    def shares(self, vec: Column, folds: Column) -> Column:
        """Class shares of a row by the trees that held out its fold, in an array of one; zeros where there are none."""
        of = {p.fold: (first, [r[i] for r in self.rounds]) for i, (p, first) in enumerate(zip(self.problems, self.first, strict=True))}
        k, depth = self.n_classes, self.depth

        @F.arrow_udf("array<array<double>>")
        def shared(x: pa.Array, own: pa.Array) -> pa.Array:
            x, own = _matrix(x), _matrix(own, np.int64)[:, 0]
            out = np.zeros((len(own), k))
            for fold, (first, rounds) in of.items():
                mine = own == fold
                if mine.any():
                    out[mine] = _shares(_applied(rounds, np.tile(first, (int(mine.sum()), 1)), x[mine], False, depth))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32)), _lists(out))

        return shared(vec.cast("array<double>"), F.transform(folds, lambda f: F.coalesce(f, F.lit(OUT)).cast("long")))


def _applied(rounds: Sequence, scores: np.ndarray, x: np.ndarray, binned: bool, depth: int) -> np.ndarray:
    for trees in rounds:
        for c, tree in enumerate(trees):
            scores[:, c] += tree.value[tree.nodes(x, binned, depth)]
    return scores


def bin_edges(df: DataFrame, *, vec: str, fold: str | None, folds: Sequence, bins: int) -> list[list[np.ndarray]]:
    """Per fold and feature the values that end a bin: distinct quantiles of the fold's training side without the largest value.

    Quantiles are taken ``FINE`` times as dense as bins, so that a feature of few values has each of them as a cut; where they
    are more than ``bins``, every ``FINE``-th is used.
    """
    long = df.select(*([fold] if fold else []), F.posexplode(F.col(vec).cast("array<double>")).alias("j", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    points = [i / (FINE * bins) for i in range(1, FINE * bins + 1)]

    def side(f) -> Column:
        return F.when(F.col(fold) != F.lit(f), F.col("v")) if fold else F.col("v")

    quantiles = long.groupBy("j").agg(*[F.percentile_approx(side(f), points).alias(f"q{i}") for i, f in enumerate(folds)], *[F.max(side(f)).alias(f"m{i}") for i, f in enumerate(folds)])
    found = {r["j"]: r for r in quantiles.collect()}  # one row for each feature
    d = len(df.select(vec).first()[0])

    def cuts(j: int, i: int) -> np.ndarray:
        fine = (found[j][f"q{i}"] if j in found else None) or []
        below = [v for v in fine if v < found[j][f"m{i}"]]
        return np.unique(below if len(set(below)) <= bins else [v for v in fine[FINE - 1 :: FINE] if v < found[j][f"m{i}"]])

    return [[cuts(j, i) for j in range(d)] for i in range(len(folds))]


def _packed(df: DataFrame, *, vec: str, target: Column, fold: str | None, folds: Sequence, edges: list, first: Sequence[np.ndarray], n_rows: int) -> DataFrame:
    """Blocks of rows as bytes: bins for every fold, classes, places of the folds, scores for every fold."""
    spot = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int") - 1 if fold else F.lit(-1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = _matrix(part.column("_x"))
                codes = np.zeros((len(folds), *x.shape), np.uint8)
                for k, of in enumerate(edges):
                    for j, e in enumerate(of):
                        codes[k, :, j] = np.where(np.isnan(x[:, j]), NULL, np.searchsorted(e, x[:, j], side="left"))
                scores = np.stack([np.tile(s, (len(x), 1)) for s in first])
                values = [len(x), codes.tobytes(), part.column("_t").to_numpy().astype(np.int32).tobytes(), part.column("_f").to_numpy().astype(np.int32).tobytes(), scores.tobytes()]
                yield _block(values)

    rows = df.select(F.col(vec).cast("array<double>").alias("_x"), target.cast("int").alias("_t"), spot.alias("_f"))
    session = df.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(max(1, min(tasks, -(-n_rows // SPREAD))))  # a join before may have left few tasks, and every level scans the blocks
    return durable(rows.mapInArrow(pack, _SCHEMA))


_SCHEMA = "n int, x binary, t binary, f binary, s binary"


def _block(values: list) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["n", "x", "t", "f", "s"])


def _reader(n_folds: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                yield (
                    np.frombuffer(r["x"], np.uint8).reshape(n_folds, n, -1), np.frombuffer(r["t"], np.int32), np.frombuffer(r["f"], np.int32),
                    np.frombuffer(r["s"], np.float64).reshape(n_folds, n, -1),
                )

    return read


def _histograms(shared, k: int, slots: int, depth: int):
    """{fold and class: (gradient, curvature, rows) of node, feature and bin} of the level that is being grown."""

    def add(blocks) -> dict[int, np.ndarray]:
        level, weights, growing, pending = shared.value
        out: dict = {}
        for x, t, f, s in blocks:
            for i, w in enumerate(weights):
                mine = f != i
                if not mine.any():
                    continue
                codes, y = x[i][mine], t[mine]
                shares = _shares(_applied(pending[i], s[i][mine].copy(), codes, True, depth))
                d, own = codes.shape[1], w[y]
                columns = np.where(codes == NULL, slots - 1, codes.astype(np.int64)) + np.arange(d) * slots
                for c in range(k):
                    p = shares[:, 1] if k == 1 else shares[:, c]
                    tree, start = growing[i][c], 2**level - 1
                    at = tree.nodes(codes, True, level)
                    here = at >= start
                    if not here.any():
                        continue
                    p, hit, u = p[here], (y[here] == (1 if k == 1 else c)), own[here]
                    spots = (columns[here] + ((at[here] - start) * (d * slots))[:, None]).ravel()
                    size = 2**level * d * slots
                    sums = np.concatenate([np.bincount(spots, np.repeat(v, d), size) for v in (u * (p - hit), u * p * (1 - p), np.ones(len(u)))])
                    key = i * k + c
                    out[key] = out[key] + sums if key in out else sums
        return out

    return add


def _split(tree: Tree, level: int, sums: np.ndarray, edges: list[np.ndarray], spec: RoutedTrees, slots: int) -> bool:
    """Cut the nodes of a level where that pays and set the scores of their children; False when nothing was cut."""
    start, d = 2**level - 1, len(edges)
    g, h, n = sums.reshape(3, 2**level, d, slots)
    cut_any = False
    for node in range(2**level):
        total = [v[node, 0].sum() for v in (g, h, n)]
        if total[2] < 1:
            continue
        at = start + node
        if level == 0:
            tree.value[at] = -spec.rate * total[0] / (total[1] + spec.penalty)
        best = (1e-9, None)
        null = [v[node, :, -1] for v in (g, h, n)]
        below = [np.cumsum(v[node, :, :-1], axis=1) for v in (g, h, n)]
        for null_left in (True, False):
            left = [b + (z[:, None] if null_left else 0.0) for b, z in zip(below, null, strict=True)]
            right = [t - v for t, v in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + spec.penalty) + right[0] ** 2 / (right[1] + spec.penalty) - total[0] ** 2 / (total[1] + spec.penalty)
            gain = np.where((left[2] >= spec.min_rows) & (right[2] >= spec.min_rows), gain, -np.inf)
            j, b = divmod(int(gain.argmax()), slots - 1)
            if gain[j, b] > best[0]:
                side = null_left if null[2][j] else bool(left[2][j, b] >= right[2][j, b])
                best = (gain[j, b], (j, b, side, [(q[0][j, b], q[1][j, b]) for q in (left, right)]))
        if best[1] is None:
            continue
        j, b, side, children = best[1]
        tree.feature[at], tree.bin[at], tree.null_left[at] = j, b, side
        tree.cut[at] = edges[j][b] if b < len(edges[j]) else np.inf
        for child, (gs, hs) in zip((2 * at + 1, 2 * at + 2), children, strict=True):
            tree.value[child] = -spec.rate * gs / (hs + spec.penalty)
        cut_any = True
    return cut_any


def fit_routed(df: DataFrame, spec: RoutedTrees, *, vec: str, target: Column, n_classes: int, fold: str | None = None, balance: bool = True) -> Routed:
    """Trees of every fold (without ``fold`` one fit on all rows), grown together.

    Vectors are given and equally long, their elements may be null or NaN; an undeclared class raises in ``target``; rows without a fold take no part; a fold whose
    training side lacks a class raises; an empty table gives no problem. The driver holds histograms: folds x classes x nodes x features x bins.
    """
    if not 2 <= spec.bins <= NULL - 1:
        raise ValueError(f"bins must lie between 2 and {NULL - 1}")
    rows = df.where(F.col(fold).isNotNull()) if fold else df
    counted = rows.groupBy(*([fold] if fold else []), target.alias("_t")).count().collect()
    folds = sorted({r[fold] for r in counted}) if fold else [NONE]
    if not counted:
        return Routed([], [], [], spec.depth, n_classes)
    k = 1 if n_classes == 2 else n_classes
    weights, first = [], []
    for f in folds:
        counts = np.zeros(n_classes)
        for r in counted:
            counts[r["_t"]] += r["count"] if not fold or r[fold] != f else 0
        if (counts == 0).any():
            raise ValueError(f"fold {f} has no training row of class {np.flatnonzero(counts == 0).tolist()}")
        weights.append(counts.sum() / (n_classes * counts) if balance else np.ones(n_classes))
        mass = np.log(weights[-1] * counts)
        first.append(mass[1:] - mass[0] if k == 1 else mass - mass.mean())
    edges = bin_edges(rows, vec=vec, fold=fold, folds=folds, bins=spec.bins)
    slots = max(len(e) for of in edges for e in of) + 2  # one bin more than edges, and the nulls
    blocks = _packed(rows, vec=vec, target=target, fold=fold, folds=folds, edges=edges, first=first, n_rows=sum(r["count"] for r in counted))
    read, context = _reader(len(folds)), df.sparkSession.sparkContext
    rounds: list = []
    pending: list = [[] for _ in folds]
    for number in range(spec.rounds):
        growing = [[_seed(spec.depth) for _ in range(k)] for _ in folds]
        for level in range(spec.depth):
            shared = context.broadcast((level, weights, growing, pending))  # trees of a few rounds
            sums = _sums(blocks, _histograms(shared, k, slots, spec.depth), read)
            shared.unpersist()
            if not any([_split(growing[key // k][key % k], level, v, edges[key // k], spec, slots) for key, v in sums.items()]):
                break
        rounds.append(growing)
        for i, trees in enumerate(growing):
            pending[i].append(trees)
        if (number + 1) % REFRESH == 0 and number + 1 < spec.rounds:
            blocks = _refreshed(blocks, read, pending, spec.depth)
            pending = [[] for _ in folds]
    return Routed([Problem(0, f, 0) for f in folds], first, rounds, spec.depth, n_classes)


def _refreshed(blocks: DataFrame, read, pending: list, depth: int) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, t, f, s in read(batches):
            scores = np.stack([_applied(pending[i], s[i].copy(), x[i], True, depth) for i in range(len(pending))])
            yield _block([len(t), x.tobytes(), t.tobytes(), f.tobytes(), scores.tobytes()])

    return durable(blocks.mapInArrow(write, _SCHEMA))
