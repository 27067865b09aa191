"""The stacked solver and the keyed permutations against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators import resample as S
from kinfold.operators import shuffles as H
from kinfold.operators.stacked import fit_stacked


def direct(x, y, k, weights, c=1.0, scale=True):
    """Softmax or logistic fit by plain Newton steps on the scaled features of one training side."""
    mean, sd = (x.mean(0), x.std(0) + 1e-8) if scale else (0.0, 1.0)
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    n, m = z.shape
    hot = np.eye(k)[y]
    w = weights[y]
    b = np.zeros((k, m))
    ridge = np.r_[np.full(m - 1, 1 / (c * n)), 0.0]
    for _ in range(60):
        e = z @ b.T
        p = np.exp(e - e.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - hot) * w[:, None]).T @ z / w.sum() + ridge * b
        h = np.zeros((k, m, k, m))
        for i in range(k):
            for j in range(k):
                h[i, :, j, :] = (z * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z / w.sum()
            h[i, :, i, :] += np.diag(ridge)
        h[:, -1, :, -1] += 1.0
        b -= np.linalg.lstsq(h.reshape(k * m, k * m), g.ravel(), rcond=None)[0].reshape(k, m)
    w_ = b[:, :-1] / sd
    return np.hstack([w_, (b[:, -1] - w_ @ np.broadcast_to(mean, x.shape[1]))[:, None]])


def table(spark, k=3, n=300, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 5
    y = (np.argmax((x - 5) @ rng.normal(size=(d, k)) + rng.normal(size=(n, k)) * 3, axis=1)).astype(int)
    folds = np.stack([np.arange(n) % 3, np.arange(n) // 7 % 2], axis=1)
    other = rng.permutation(y)
    pdf = pd.DataFrame({"row_id": np.arange(n), "x": [v.tolist() for v in x], "y": y, "other": other, "f0": folds[:, 0], "f1": folds[:, 1]})
    return spark.createDataFrame(pdf).select("row_id", "x", *[F.col(c).cast("int").alias(c) for c in ("y", "other", "f0", "f1")]), x, y, other, folds


def test_several_classes_assignments_and_arms_equal_direct_fits(spark):
    df, x, y, other, folds = table(spark)
    fit = fit_stacked(df, vec="x", targets=F.array("y", "other"), n_classes=3, folds=F.array("f0", F.when(F.col("row_id") >= 20, F.col("f1"))))
    assert len(fit.problems) == 2 * (3 + 2) and all(fit.converged) and fit.steps < 15
    for p, w in zip(fit.problems, fit.coef, strict=True):
        own = folds[:, p.assignment] != p.fold
        if p.assignment == 1:
            own &= np.arange(len(x)) >= 20
        t = (y, other)[p.arm][own]
        counts = np.bincount(t, minlength=3)
        assert np.allclose(w, direct(x[own], t, 3, own.sum() / (3 * counts)), atol=1e-6)


def test_two_classes_arms_that_leave_rows_out_and_unscaled_features(spark):
    df, x, y, *_ = table(spark)
    arms = F.array(F.when(F.col("y") < 2, F.col("y")), F.when(F.col("y") > 0, F.col("y") - 1))
    for scale in (True, False):
        fit = fit_stacked(df, vec="x", targets=arms, balance=False, scale=scale, c=0.3)
        for a, (own, t) in enumerate(((y < 2, y), (y > 0, y - 1))):
            two = direct(x[own], t[own], 2, np.ones(2), c=0.3, scale=scale)
            # a two-column softmax with the penalty halved on the difference is not the same fit, so compare gradients instead
            w = fit.coef[a][0]
            m, s = (x[own].mean(0), x[own].std(0) + 1e-8) if scale else (0.0, 1.0)
            beta = w[:-1] * s
            p = 1 / (1 + np.exp(-(x[own] @ w[:-1] + w[-1])))
            g = ((p - t[own])[:, None] * (x[own] - m) / s).mean(0) + beta / (0.3 * own.sum())
            assert np.abs(g).max() < 1e-8 and abs((p - t[own]).mean()) < 1e-8
            assert two.shape == (2, 5)


def test_wide_fit_equals_the_ml_estimator(spark):
    rng = np.random.default_rng(3)
    n, d = 600, 64
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 30, d) + rng.normal(size=d) * 100
    y = (x[:, 0] / x[:, 0].std() + rng.normal(size=n) > x[:, 0].mean() / x[:, 0].std()).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "fold": np.arange(n) % 2, "vec": [v.tolist() for v in x], "y": y}))
    df = df.withColumn("fold", F.col("fold").cast("int")).withColumn("y", F.col("y").cast("int"))
    got = L.out_of_fold(df, L.logistic(), row_id="row_id", vec="vec", label="y", classes=(0, 1)).toPandas().set_index("row_id")["proba"]
    for f in (0, 1):
        tr = np.arange(n) % 2 != f
        m, s = x[tr].mean(0), x[tr].std(0) + 1e-8
        z = np.hstack([(x - m) / s, np.ones((n, 1))])
        w = np.where(y == 1, 0.5 / y[tr].mean(), 0.5 / (1 - y[tr].mean()))
        b, ridge = np.zeros(d + 1), np.r_[np.ones(d), 0.0]
        for _ in range(60):
            p = 1 / (1 + np.exp(-z[tr] @ b))
            b -= np.linalg.solve((z[tr] * (w[tr] * p * (1 - p))[:, None]).T @ z[tr] + np.diag(ridge + 1e-12), z[tr].T @ (w[tr] * (p - y[tr])) + ridge * b)
        want = 1 / (1 + np.exp(-z @ b))
        for i in np.flatnonzero(~tr):
            assert got[i][1] == pytest.approx(want[i], abs=1e-6)


def test_jobs_do_not_grow_with_folds_and_arms(spark):
    df, *_ = table(spark)
    tracker = spark.sparkContext.statusTracker()

    def jobs(arms, folds):
        spark.sparkContext.setJobGroup(f"g{len(arms)}{len(folds)}", "stacked")
        fit_stacked(df, vec="x", targets=F.array(*arms), n_classes=3, folds=F.array(*folds))
        found = tracker.getJobIdsForGroup(f"g{len(arms)}{len(folds)}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert jobs(["y"] * 12, ["f0", "f1"] * 3) <= jobs(["y"], ["f0"]) + 4


def test_a_missing_class_and_an_undeclared_one_raise(spark):
    df, *_ = table(spark)
    with pytest.raises(ValueError, match="no training row"):
        fit_stacked(df, vec="x", targets=F.array(F.col("f0")), n_classes=3, folds=F.array("f0"))
    with pytest.raises(Exception, match="undeclared class"):
        L.out_of_fold(df.withColumn("fold", F.col("f0")), L.logistic(), row_id="row_id", vec="x", label="y", classes=(0, 1))


def test_separable_classes_converge(spark):
    df = spark.createDataFrame([(i, [float(i)], int(i > 20), i % 2) for i in range(40)], "row_id int, x array<double>, y int, fold int")
    fit = fit_stacked(df, vec="x", targets=F.array("y"), folds=F.array("fold"), c=1e6)
    assert all(fit.converged) and np.isfinite(fit.coef[0]).all()


# --- keyed permutations -------------------------------------------------------------------


@pytest.mark.parametrize("m", [1, 2, 3, 5, 16, 17, 100, 1001])
def test_every_draw_is_a_bijection(spark, m):
    keys = H.draw_keys(spark, 20, 3)
    out = H.landing(np.arange(m), keys, 12345, m)
    assert all(sorted(out[:, j].tolist()) == list(range(m)) for j in range(20))
    if m > 16:
        assert len({tuple(out[:, j]) for j in range(20)}) == 20


def test_landings_are_spread_evenly(spark):
    keys = H.draw_keys(spark, 4000, 8)
    out = H.landing(np.arange(30), keys, 7, 30)
    counts = np.stack([np.bincount(out[i], minlength=30) for i in range(30)])
    z = (counts - 4000 / 30) / math.sqrt(4000 / 30 * 29 / 30)
    assert abs(z).max() < 5 and 0.8 < z.std() < 1.2
    pairs = np.bincount(out[3] * 30 + out[4], minlength=900).reshape(30, 30)
    assert (np.diag(pairs) == 0).all() and pairs[~np.eye(30, dtype=bool)].min() >= 0
    z = (pairs[~np.eye(30, dtype=bool)] - 4000 / 870) / math.sqrt(4000 / 870)
    assert 0.85 < z.std() < 1.15


def test_shuffled_labels_keep_the_counts_of_each_group(spark):
    rows = [(i, i % 3, "abcc"[i * 7 % 4] if i % 3 else "z") for i in range(97)]
    df = spark.createDataFrame(rows, "row_id int, fold int, label string")
    got = H.shuffled_labels(df, row_id="row_id", label="label", n=9, seed=4, within="fold").toPandas()
    for f in range(3):
        own = got[got.fold == f]
        for j in range(9):
            assert sorted(v[j] for v in own["_shuffled"]) == sorted(own.label)
    moved = sum(v[0] != a for v, a in zip(got["_shuffled"], got.label, strict=True))
    assert moved > 10
    whole = H.shuffled_labels(df, row_id="row_id", label="label", n=2, seed=4).toPandas()
    assert sorted(v[1] for v in whole["_shuffled"]) == sorted(whole.label)
    assert H.shuffled_labels(df.limit(0), row_id="row_id", label="label", n=2, seed=4, within="fold").count() == 0


def test_permuted_aurocs_equal_scoring_every_draw(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        for _ in range(int(rng.integers(1, 5))):
            p = np.round(rng.dirichlet(np.ones(3)), 1)
            rows.append((len(rows), g, g % 2, "ABC"[g * 5 % 3], p.tolist()))
    df = spark.createDataFrame(rows, "row_id int, gene int, fold int, label string, proba array<double>")
    got = {(r.draw, r.fold, r.cls): r.auroc for r in S.permuted_aurocs(df, unit="gene", y="label", proba="proba", classes="ABC", fold="fold", n=6, seed=9).collect()}
    lists = S.permutation_lists(df, unit="gene", label="label", fold="fold", n=6, seed=9).select("gene", "labels")
    long = df.drop("label").join(lists.select("gene", F.posexplode("labels").alias("draw", "label")), "gene")
    ovr = M.one_vs_rest(long, y="label", proba="proba", classes=("A", "B", "C"), keep=["draw", "fold"])
    want = {(r.draw, r.fold, r.cls): r.auroc for r in M.ranking_metrics(ovr, y="target", score="score", keys=["draw", "fold", "cls"]).collect()}
    assert got.keys() == want.keys() and len(got) == 36
    assert all((a is None and want[k] is None) or a == pytest.approx(want[k]) for k, a in got.items())
