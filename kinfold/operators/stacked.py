"""Logistic fits of all folds, arms and draws together: a stacked Newton solver.

A problem is one (assignment, held-out fold, arm): an assignment deals the rows to folds, an arm (a label, a
pair of classes, a draw of shuffled labels) gives every row a class or leaves it out. Each step scans the rows once for all
problems that are still open: a task multiplies a block of rows by all coefficient vectors at once and adds up every problem's loss, gradient and Hessian;
the sums meet in a shuffle whose size depends on the problems and the width of the vectors, not on the rows. The
driver then takes the Newton step of each problem. So the number of jobs is the
number of steps (about ten), whatever the number of folds, arms and draws.

The features of a problem are any affine map of the raw vector: standardised by the training side, reduced to
its principal axes, or the vector itself. Sums are made in coordinates that all problems share, and
mapped on the driver. The objective is the weighted mean loss plus ``|w|² / (2 c n)``; intercepts are free. A step that does not
lower the objective is halved. ``converged`` tells whether a problem's last step was below the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.gram import MAX_DIM, vector_sum
from kinfold.session import durable

#: Rows that a task multiplies at once, numbers in one row of the shuffle, and bytes of sums that the driver holds at once.
BLOCK, CHUNK, HELD_BYTES = 4096, 1 << 14, 128 << 20
#: Fold number of a row that an assignment leaves out, and the held-out fold of a fit on all rows.
OUT, NONE = -9, -1


class Problem(NamedTuple):
    assignment: int
    fold: int
    arm: int


@dataclass(frozen=True)
class Stacked:
    """Fitted problems; ``coef[p]`` has one row per class (one row in all for two classes): weights of the raw vector, then the intercept."""

    problems: list
    coef: list
    #: The same in the problem's own features (scaled, reduced or given).
    scaled: list
    converged: list
    steps: int
    n_classes: int

    def shares(self, vec: Column, folds: Column, arm: int = 0) -> Column:
        """Class shares of a row, for each assignment by the model that held the row's fold out; zeros where it has none."""
        table = {(p.assignment, p.fold): w for p, w in zip(self.problems, self.coef, strict=True) if p.arm == arm}
        k = self.n_classes

        @F.arrow_udf("array<array<double>>")
        def shared(x: pa.Array, own: pa.Array) -> pa.Array:
            u, own = _extended(_matrix(x)), _matrix(own, np.int64)
            out = np.zeros((len(u), own.shape[1], k))
            for (s, f), w in table.items():
                mine = own[:, s] == f
                out[mine, s] = _shares(u[mine] @ w.T)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * own.shape[1]), _lists(out.reshape(-1, k)))

        return shared(vec.cast("array<double>"), F.transform(folds, lambda f: F.coalesce(f, F.lit(OUT)).cast("long")))

    def held_out(self, vec: Column, fold: Column) -> Column:
        """Decision values of a row in all arms (of two classes, one assignment) by the models that held its fold out."""
        arms = 1 + max(p.arm for p in self.problems)
        table: dict = {}
        for p, w in zip(self.problems, self.coef, strict=True):
            table.setdefault(p.fold, np.zeros((arms, w.shape[1])))[p.arm] = w[0]

        @F.arrow_udf("array<double>")
        def decided(x: pa.Array, own: pa.Array) -> pa.Array:
            u, own = _extended(_matrix(x)), own.to_numpy(zero_copy_only=False)
            out = np.zeros((len(u), arms))
            for f, w in table.items():
                out[own == f] = u[own == f] @ w.T
            return _lists(out)

        return decided(vec.cast("array<double>"), fold)

    def decisions(self, vec: Column, of: Sequence[int] | None = None) -> Column:
        """Decision values of a row, one for each problem (of two classes), as an array."""
        w = np.vstack([self.coef[i] for i in (range(len(self.coef)) if of is None else of)])

        @F.arrow_udf("array<double>")
        def decided(x: pa.Array) -> pa.Array:
            return _lists(_extended(_matrix(x)) @ w.T)

        return decided(vec.cast("array<double>"))


def _matrix(x: pa.Array, kind=np.float64) -> np.ndarray:
    if not len(x):
        return np.zeros((0, 1), kind)
    flat = x.flatten()
    if x.null_count or len(flat) % len(x):
        raise ValueError("vectors must be given and equally long")
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(x), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _extended(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _shares(eta: np.ndarray) -> np.ndarray:
    """Class shares from decision values; one column stands for the second of two classes."""
    if eta.shape[1] == 1:
        p = 0.5 * (1.0 + np.tanh(0.5 * eta[:, 0]))
        return np.stack([1.0 - p, p], axis=1)
    e = np.exp(eta - eta.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield _matrix(part.column("_x")), _matrix(part.column("_f"), np.int32), _matrix(part.column("_t"), np.int32)


def _sums(rows: DataFrame, add, read=_blocks) -> dict[int, np.ndarray]:
    """{key: array} of what ``add(blocks) -> {key: array}`` makes of every task, summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values in add(read(batches)).items():
            for i in range(0, len(values), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([i], pa.int32()), pa.array([values[i : i + CHUNK]], pa.list_(pa.float64()))], names=["key", "at", "part"])

    summed = rows.mapInArrow(run, "key long, at int, part array<double>").groupBy("key", "at").agg(vector_sum("part").alias("part"))
    table = summed.toArrow().combine_chunks()
    lists = table.column("part").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
    flat, stop = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    found: dict[int, dict] = {}
    for key, at, a, b in zip(table.column("key").to_pylist(), table.column("at").to_pylist(), np.append(0, stop[:-1]), stop, strict=True):
        found.setdefault(key, {})[at] = flat[a:b]
    return {key: np.concatenate([parts[at] for at in sorted(parts)]) for key, parts in found.items()}


def _moments(rows: DataFrame, n_classes: int) -> dict[tuple, np.ndarray]:
    """{(assignment, fold, arm): class counts, sums, squares} of the rows that lie in that fold and arm."""
    index: dict[int, tuple] = {}
    arms, assignments = (len(x) for x in rows.select("_t", "_f").first())

    def add(blocks) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for x, f, t in blocks:
            both = np.hstack([x, x * x])
            for s in range(assignments):
                for g in np.unique(f[:, s]).tolist():
                    mine = f[:, s] == g
                    if g == OUT:
                        continue
                    own, xs = t[mine], both[mine]
                    counts = np.stack([(own == c).sum(axis=0) for c in range(n_classes)], axis=1)
                    values = np.hstack([counts, (own >= 0).T.astype(float) @ xs])
                    for a in range(arms):
                        key = ((g + 1) * assignments + s) * arms + a
                        out[key] = out[key] + values[a] if key in out else values[a]
        return out

    for key, values in _sums(rows, add).items():
        index[(key // arms % assignments, key // arms // assignments - 1, key % arms)] = values
    return index


def fit_stacked(
    df: DataFrame, *, vec: str | Column, targets: Column, n_classes: int = 2, folds: Column | None = None, balance: bool = True, scale: bool = True,
    maps: Mapping | None = None, c: float = 1.0, tol: float = 1e-6, max_steps: int = 100,
) -> Stacked:
    """All problems of ``df``.

    ``targets``: array<int> with a row's class in each arm, negative or null where the arm leaves the row
    out. ``folds``: array<int> with a row's fold in each assignment (null: left out), or None for one fit on all rows. ``maps``:
    {(assignment, fold): (mean, axes)} puts features on axes instead of scaling. ``balance`` weighs classes to equal sums.
    """
    fold_list = folds if folds is not None else F.array(F.lit(NONE))
    rows = durable(
        df.select(
            (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>").alias("_x"),
            F.transform(fold_list, lambda v: F.coalesce(v, F.lit(OUT)).cast("int")).alias("_f"),
            F.transform(targets, lambda v: F.coalesce(v, F.lit(-1)).cast("int")).alias("_t"),
        )
    )
    if rows.isEmpty():
        return Stacked([], [], [], [], 0, n_classes)
    parts = _moments(rows, n_classes)
    d = (len(next(iter(parts.values()))) - n_classes) // 2
    k = 1 if n_classes == 2 else n_classes
    if k * (d + 1) > MAX_DIM + 2:
        raise ValueError(f"more than {MAX_DIM} coefficients need a reduced basis first")
    everything = sum(v for (s, _, a), v in parts.items() if (s, a) == (0, 0))
    base_n = max(everything[:n_classes].sum(), 1.0)
    centre = everything[n_classes : n_classes + d] / base_n
    spread = np.sqrt(np.maximum(everything[n_classes + d :] / base_n - centre**2, 0.0)) + 1e-8

    problems, maps_, lambdas, weights = [], [], [], []
    for s, f, a in sorted(parts):
        training = sum((v for (s2, f2, a2), v in parts.items() if (s2, a2) == (s, a) and (f2 != f or folds is None)), np.zeros(n_classes + 2 * d))
        counts = training[:n_classes]
        if (counts == 0).any():
            raise ValueError(f"assignment {s}, fold {f}, arm {a} has no training row of class {np.flatnonzero(counts == 0).tolist()}")
        n = counts.sum()
        if maps is not None:
            mean, axes = maps[(s, f)]
        elif scale:
            mean = training[n_classes : n_classes + d] / n
            axes = np.diag(1.0 / (np.sqrt(np.maximum(training[n_classes + d :] / n - mean**2, 0.0)) + 1e-8))
        else:
            mean, axes = np.zeros(d), np.eye(d)
        to = np.zeros((len(axes) + 1, d + 1))  # shared coordinates to the problem's features
        to[:-1, :-1], to[:-1, -1], to[-1, -1] = axes * spread, axes @ (centre - mean), 1.0
        problems.append(Problem(s, f, a))
        maps_.append(to)
        lambdas.append(1.0 / (c * n))
        weights.append(n / (n_classes * counts) if balance else np.ones(n_classes))
    totals = [float(training_weight(parts, p, n_classes, w, folds is None)) for p, w in zip(problems, weights, strict=True)]

    state = [_Newton(np.zeros((k, len(m))), m, l, t) for m, l, t in zip(maps_, lambdas, totals, strict=True)]
    size = 8 * (1 + k * (d + 1) + k * (k + 1) // 2 * (d + 1) ** 2)
    at_once = max(1, HELD_BYTES // size)
    steps = 0
    while steps < max_steps and (open_ := [i for i, x in enumerate(state) if not x.converged]):
        steps += 1
        for i in range(0, len(open_), at_once):
            some = open_[i : i + at_once]
            gammas = [state[j].beta @ maps_[j] for j in some]
            sums = _sums(rows, _adder([problems[j] for j in some], gammas, [weights[j] for j in some], centre, spread))
            for j, values in zip(some, (sums[q] for q in range(len(some))), strict=True):
                state[j].step(values, tol)
    coef = []
    for x, m in zip(state, maps_, strict=True):
        g = x.beta @ m
        w = g[:, :-1] / spread
        coef.append(np.hstack([w, (g[:, -1] - w @ centre)[:, None]]))
    return Stacked(problems, coef, [x.beta for x in state], [x.converged for x in state], steps, n_classes)


def training_weight(parts: Mapping, p: Problem, n_classes: int, w: np.ndarray, whole: bool) -> float:
    return sum(float(v[:n_classes] @ w) for (s, f, a), v in parts.items() if (s, a) == (p.assignment, p.arm) and (whole or f != p.fold))


def _adder(problems: Sequence[Problem], gammas: Sequence[np.ndarray], weights: Sequence[np.ndarray], centre: np.ndarray, spread: np.ndarray):
    """Loss, gradient and Hessian of every problem over a task's rows, flat, in the shared coordinates."""
    k, d1 = gammas[0].shape
    stack = np.vstack(gammas)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def add(blocks) -> dict[int, np.ndarray]:
        out = {q: np.zeros(1 + k * d1 + len(pairs) * d1 * d1) for q in range(len(problems))}
        for x, f, t in blocks:
            u = _extended((x - centre) / spread)
            every = u @ stack.T
            for q, p in enumerate(problems):
                y = t[:, p.arm]
                use = (y >= 0) & (f[:, p.assignment] != OUT)
                if p.fold != NONE:
                    use &= f[:, p.assignment] != p.fold
                if not use.any():
                    continue
                y, eta, v = y[use], every[use, q * k : (q + 1) * k], u[use]
                w = weights[q][y]
                sums = out[q]
                if k == 1:
                    e = eta[:, 0]
                    share = 0.5 * (1.0 + np.tanh(0.5 * e))
                    sums[0] += w @ (np.logaddexp(0.0, e) - y * e)
                    sums[1 : 1 + d1] += (w * (share - y)) @ v
                    h = v * np.sqrt(w * share * (1.0 - share))[:, None]
                    sums[1 + d1 :] += (h.T @ h).ravel()
                    continue
                share = _shares(eta)
                top = eta.max(axis=1)
                sums[0] += w @ (top + np.log(np.exp(eta - top[:, None]).sum(axis=1)) - eta[np.arange(len(y)), y])
                r = share.copy()
                r[np.arange(len(y)), y] -= 1.0
                sums[1 : 1 + k * d1] += ((r * w[:, None]).T @ v).ravel()
                for b, (i, j) in enumerate(pairs):
                    at = 1 + k * d1 + b * d1 * d1
                    sums[at : at + d1 * d1] += (v.T @ (v * (w * share[:, i] * ((i == j) - share[:, j]))[:, None])).ravel()
        return out

    return add


class _Newton:
    """One problem's coefficients in its own features, and where its next step goes."""

    def __init__(self, beta: np.ndarray, to: np.ndarray, penalty: float, total: float) -> None:
        self.beta, self.to, self.penalty, self.total = beta, to, penalty, total
        self.before: np.ndarray | None = None
        self.loss, self.converged = np.inf, False

    def step(self, sums: np.ndarray, tol: float) -> None:
        k, m = self.beta.shape
        d1 = self.to.shape[1]
        ridge = np.full(m, self.penalty)
        ridge[-1] = 0.0
        loss = sums[0] / self.total + 0.5 * float((ridge * self.beta**2).sum())
        if self.before is not None and not loss <= self.loss + 1e-12 * abs(self.loss):
            self.beta = 0.5 * (self.beta + self.before)
            self.converged = float(np.abs(self.beta - self.before).max()) < tol * 1e-3
            return
        g = sums[1 : 1 + k * d1].reshape(k, d1) @ self.to.T / self.total + ridge * self.beta
        h = np.zeros((k, m, k, m))
        at = 1 + k * d1
        for i in range(k):
            for j in range(i, k):
                block = self.to @ sums[at : at + d1 * d1].reshape(d1, d1) @ self.to.T / self.total
                h[i, :, j, :] = block
                h[j, :, i, :] = block.T
                at += d1 * d1
            h[i, :, i, :] += np.diag(ridge)
        if k > 1:  # intercepts may all move together; this keeps their sum at zero
            h[:, -1, :, -1] += 1.0
        h = h.reshape(k * m, k * m)
        jitter = 1e-12 * max(1.0, float(np.trace(h)) / len(h))
        delta = np.linalg.solve(h + jitter * np.eye(len(h)), g.ravel()).reshape(k, m)
        self.before, self.loss = self.beta, loss
        self.beta = self.beta - delta
        self.converged = float(np.abs(delta).max()) < tol
