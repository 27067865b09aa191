"""Networks of all folds trained together and stopped early on whole groups held back from training.

Rows are packed once into units of about ``UNIT`` rows, chosen by a hash of the row id, so a unit does not depend on how the
input is partitioned. An epoch is one job for every fold that is still open: each unit starts at the shared weights, passes once over
its training rows in small batches (Adam), and hands on its weights times its rows; tasks add these up and the sums meet in
a shuffle as wide as the network, whatever the number of rows. The next weights are the average.
The same job scores the held-back rows at the weights it starts from, so an epoch costs no second scan.

A fold stops when its held-back loss has not fallen by ``tolerance`` for ``patience`` epochs; the weights of its best epoch are
kept. Draws (first weights, batch order, dropped nodes) depend on seed, fold, epoch and unit only, so recomputed tasks
repeat them. Features are standardised by the rows that are trained on, and classes weigh
the same in total. Rows of a held-out fold never meet that fold's network before prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.rows import attach_row
from kinfold.operators.stacked import OUT, Problem, _lists, _matrix, _shares, _sums
from kinfold.session import durable

#: Rows of a unit on average; a unit of more than twice as many (repeated row ids) is cut.
UNIT = 4096


@dataclass(frozen=True)
class Network:
    """A feed-forward classifier with rectified hidden layers and early stopping; needs ``held`` and ``group`` in ``fit_folds``."""

    hidden: tuple = (64,)
    rate: float = 1e-3
    dropout: float = 0.3
    decay: float = 1e-3
    batch: int = 256
    max_epochs: int = 100
    patience: int = 10
    tolerance: float = 1e-4
    seed: int = 0


@dataclass(frozen=True)
class Networks:
    """Fitted networks, one for each fold, with the course of their held-back losses."""

    problems: list
    layers: list
    mean: list
    scale: list
    #: [(epoch, held-back loss)] of every fold, and the epoch whose weights are kept.
    course: list
    kept: list
    n_classes: int

    def shares(self, vec: Column, folds: Column) -> Column:
        """Class shares of a row by the network that held out its fold, in an array of one; zeros where there is none."""
        table = {p.fold: (m, s, w) for p, m, s, w in zip(self.problems, self.mean, self.scale, self.layers, strict=True)}
        k = self.n_classes

        @F.arrow_udf("array<array<double>>")
        def shared(x: pa.Array, own: pa.Array) -> pa.Array:
            x, own = _matrix(x), _matrix(own, np.int64)[:, 0]
            out = np.zeros((len(own), k))
            for fold, (mean, scale, layers) in table.items():
                mine = own == fold
                if mine.any():
                    out[mine] = _shares(forward(layers, (x[mine] - mean) / scale)[-1])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32)), _lists(out))

        return shared(vec.cast("array<double>"), F.transform(folds, lambda f: F.coalesce(f, F.lit(OUT)).cast("long")))

    def history(self, spark: SparkSession) -> DataFrame:
        """(fold, epoch, loss, kept): the held-back loss after every epoch, epoch 0 being the first weights."""
        rows = [(p.fold, e, v, e == k) for p, course, k in zip(self.problems, self.course, self.kept, strict=True) for e, v in course]
        return spark.createDataFrame(rows, "fold int, epoch int, loss double, kept boolean")


def forward(layers: Sequence, z: np.ndarray, drop: Sequence[np.ndarray] = ()) -> list[np.ndarray]:
    """Inputs of every layer, then the decision values; ``drop`` holds the factors of the hidden nodes."""
    out = [z]
    for i, (w, b) in enumerate(layers):
        z = z @ w + b
        if i < len(layers) - 1:
            z = np.maximum(z, 0.0)
            if drop:
                z = z * drop[i]
        out.append(z)
    return out


def gradient(layers: Sequence, z: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: Sequence[np.ndarray] = ()) -> list:
    """Gradient of the weighted mean cross entropy for every layer's (weights, intercepts)."""
    seen = forward(layers, z, drop)
    back = _shares(seen[-1])
    back[np.arange(len(y)), y] -= 1.0
    back *= (weight / weight.sum())[:, None]
    out: list = [None] * len(layers)
    for i in reversed(range(len(layers))):
        out[i] = (seen[i].T @ back, back.sum(axis=0))
        if i:
            back = (back @ layers[i][0].T) * (seen[i] > 0)
            if drop:
                back = back * drop[i - 1]
    return out


def losses(layers: Sequence, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross entropy of every row."""
    e = forward(layers, z)[-1]
    top = e.max(axis=1)
    return top + np.log(np.exp(e - top[:, None]).sum(axis=1)) - e[np.arange(len(y)), y]


def _flat(layers: Sequence) -> np.ndarray:
    return np.concatenate([part.ravel() for pair in layers for part in pair])


def _layers(flat: np.ndarray, widths: Sequence[int]) -> list:
    out, at = [], 0
    for a, b in zip(widths[:-1], widths[1:], strict=True):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def packed(df: DataFrame, *, row_id: str, vec: str, target: Column, fold: str, held: DataFrame, group: str, folds: Sequence) -> DataFrame:
    """Units of rows: vectors, classes, folds, and for every fold whether it holds the row back, as bytes."""
    held_by = held.groupBy(group).agg(F.collect_set(fold).alias("_by"))  # at most one entry for each fold
    rows = df.where(F.col(fold).isNotNull()).join(held_by, group, "left")
    backs = [F.coalesce(F.array_contains("_by", F.lit(f)), F.lit(False)).cast("int") for f in folds]
    spot = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int") - 1
    rows = rows.select(
        F.xxhash64(F.lit("unit"), F.col(row_id)).alias("_h"), F.col(vec).cast("array<double>").alias("_x"), target.cast("int").alias("_t"), spot.alias("_f"), F.array(*backs).alias("_b")
    )
    rows = durable(rows)
    many = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / UNIT), F.lit(1)).alias("_many"))
    dealt = attach_row(rows, many).withColumn("_u", F.pmod("_h", "_many").cast("long")).drop("_many")
    ordered = dealt.repartition("_u").sortWithinPartitions("_u", "_h", "_x", "_t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        unit, part = None, 0

        def unit_row() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            x, b = _matrix(t["_x"].combine_chunks()), _matrix(t["_b"].combine_chunks(), np.uint8)
            values = [unit, part, len(x), x.astype(np.float32).tobytes(), t["_t"].to_numpy().astype(np.int32).tobytes(), t["_f"].to_numpy().astype(np.int32).tobytes(), b.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["u", "part", "n", "x", "t", "f", "b"])

        for batch in batches:
            numbers = batch.column("_u").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                for i in range(a, z, 2 * UNIT):
                    piece = batch.slice(i, min(2 * UNIT, z - i))
                    own = int(numbers[i])
                    full = sum(w.num_rows for w in waiting) + piece.num_rows > 2 * UNIT
                    if waiting and (own != unit or full):
                        yield unit_row()
                        part, waiting = (part + 1 if own == unit else 0), []
                    elif own != unit:
                        part = 0
                    unit = own
                    waiting.append(piece)
        if waiting:
            yield unit_row()

    return durable(ordered.mapInArrow(pack, "u long, part int, n int, x binary, t binary, f binary, b binary"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            yield (
                (r["u"], r["part"]), np.frombuffer(r["x"], np.float32).reshape(n, -1).astype(np.float64), np.frombuffer(r["t"], np.int32),
                np.frombuffer(r["f"], np.int32), np.frombuffer(r["b"], np.uint8).reshape(n, -1).astype(bool),
            )


def _sides(f: np.ndarray, b: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that fold ``i`` trains on and rows it holds back."""
    training = f != i
    return training & ~b[:, i], training & b[:, i]


def _measures(units: DataFrame, folds: Sequence, n_classes: int) -> dict:
    """{fold index: class counts of trained and of held-back rows, sums and squares of trained rows}."""

    def add(blocks) -> dict[int, np.ndarray]:
        out: dict = {}
        for _, x, t, f, b in blocks:
            for i in range(len(folds)):
                fit, back = _sides(f, b, i)
                v = np.concatenate([np.bincount(t[fit], minlength=n_classes), np.bincount(t[back], minlength=n_classes), x[fit].sum(axis=0), (x[fit] ** 2).sum(axis=0)])
                out[i] = out[i] + v if i in out else v
        return out

    return _sums(units, add, _units)


def _epoch(shared, spec: Network, widths: Sequence[int], epoch: int):
    """One pass of every open fold: held-back loss and weight at the first weights, then rows times (steps, weights, moments)."""

    def add(blocks) -> dict[int, np.ndarray]:
        out: dict = {}
        for unit, x, t, f, b in blocks:
            for i, (fold, mean, scale, class_weight, start, train) in shared.value.items():
                fit, back = _sides(f, b, i)
                size = (len(start) - 1) // 3
                sums = np.zeros(3 + len(start))
                layers = _layers(start[1 : 1 + size], widths)
                if back.any():
                    w = class_weight[t[back]]
                    sums[0], sums[1] = w @ losses(layers, (x[back] - mean) / scale, t[back]), w.sum()
                if train and fit.any():
                    rng = np.random.default_rng([spec.seed, abs(int(fold)), epoch, *unit])
                    state = _pass(rng, start, (x[fit] - mean) / scale, t[fit], class_weight, spec, widths)
                    sums[2] = fit.sum()
                    sums[3:] = sums[2] * state
                out[i] = out[i] + sums if i in out else sums
        return out

    return add


def _pass(rng: np.random.Generator, start: np.ndarray, z: np.ndarray, y: np.ndarray, class_weight: np.ndarray, spec: Network, widths: Sequence[int]) -> np.ndarray:
    """State (steps, weights, first and second moments) after one pass of Adam over the rows in small batches."""
    size = (len(start) - 1) // 3
    steps, flat, first, second = start[0], start[1 : 1 + size].copy(), start[1 + size : 1 + 2 * size].copy(), start[1 + 2 * size :].copy()
    order = rng.permutation(len(y))
    for at in range(0, len(y), spec.batch):
        some = order[at : at + spec.batch]
        drop = [(rng.random((len(some), h)) >= spec.dropout) / (1.0 - spec.dropout) for h in widths[1:-1]] if spec.dropout else []
        g = _flat(gradient(_layers(flat, widths), z[some], y[some], class_weight[y[some]], drop)) + spec.decay * flat
        steps += 1
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        flat -= spec.rate * (first / (1.0 - 0.9**steps)) / (np.sqrt(second / (1.0 - 0.999**steps)) + 1e-8)
    return np.concatenate([[steps], flat, first, second])


def fit_networks(df: DataFrame, spec: Network, *, row_id: str, vec: str, target: Column, n_classes: int, fold: str, held: DataFrame, group: str) -> Networks:
    """One network for each fold, all trained together.

    ``held`` lists (fold, group) held back. Vectors must be given and equally long; an undeclared class raises in
    ``target``; rows without a fold take no part; a fold whose trained side lacks a class, or that holds back no row, raises. A group may be null: such rows are
    never held back. Repeated row ids meet in one unit, which is cut where it grows too long.
    """
    folds = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect())
    if not folds:
        return Networks([], [], [], [], [], [], n_classes)
    units = packed(df, row_id=row_id, vec=vec, target=target, fold=fold, held=held, group=group, folds=folds)
    sides = _measures(units, folds, n_classes)
    mean, scale, weights, states = [], [], [], []
    for i, f in enumerate(folds):
        v = sides[i]
        fit, back, d = v[:n_classes], v[n_classes : 2 * n_classes], (len(v) - 2 * n_classes) // 2
        if (fit == 0).any():
            raise ValueError(f"fold {f} has no training row of class {np.flatnonzero(fit == 0).tolist()}")
        if not back.sum():
            raise ValueError(f"fold {f} holds no row back")
        m = v[2 * n_classes : 2 * n_classes + d] / fit.sum()
        mean.append(m)
        scale.append(np.sqrt(np.maximum(v[2 * n_classes + d :] / fit.sum() - m * m, 0.0)) + 1e-8)
        weights.append((fit + back).sum() / (n_classes * (fit + back)))
        widths = [d, *spec.hidden, n_classes]
        rng = np.random.default_rng([spec.seed, abs(int(f))])
        first = _flat([(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(widths[:-1], widths[1:], strict=True)])
        states.append(np.concatenate([[0.0], first, np.zeros(2 * len(first))]))

    size = (len(states[0]) - 1) // 3
    best, kept, layers = [np.inf] * len(folds), [0] * len(folds), [None] * len(folds)
    course: list[list] = [[] for _ in folds]
    open_ = list(range(len(folds)))
    for epoch in range(spec.max_epochs + 1):
        train = epoch < spec.max_epochs
        shared = df.sparkSession.sparkContext.broadcast({i: (folds[i], mean[i], scale[i], weights[i], states[i], train) for i in open_})  # as wide as the network
        sums = _sums(units, _epoch(shared, spec, widths, epoch), _units)
        shared.unpersist()
        for i in list(open_):
            loss = float(sums[i][0] / sums[i][1])
            course[i].append((epoch, loss))
            if epoch and loss < best[i] - spec.tolerance:
                best[i], kept[i], layers[i] = loss, epoch, _layers(states[i][1 : 1 + size].copy(), widths)
            elif epoch - kept[i] >= spec.patience:
                open_.remove(i)
                continue
            if train:
                states[i] = sums[i][3:] / sums[i][2]
        if not open_:
            break
    if any(x is None for x in layers):
        raise ValueError(f"folds {[f for f, x in zip(folds, layers, strict=True) if x is None]} have no finite held-back loss")
    return Networks([Problem(0, f, 0) for f in folds], layers, mean, scale, course, kept, n_classes)
