"""Trees that route nulls: planted sides, histograms against direct sums, folds, edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import models as L
from kinfold.operators import routed_trees as T


def table(spark, x, y, fold=None):
    pdf = pd.DataFrame({"row_id": np.arange(len(y)), "y": y, "fold": np.arange(len(y)) % 3 if fold is None else fold})
    pdf["vec"] = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(pdf.to_dict("records"), "row_id long, y int, fold int, vec array<double>")


def two_sided(n=600, seed=0):
    """Nulls of the second feature belong with its high values where the first is low, and with its low values where it is high."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2, n).astype(float), rng.random(n).round(3)
    b[rng.random(n) < 0.3] = np.nan
    y = np.where(np.isnan(b), a == 0, b > 0.5).astype(int)
    return np.stack([a, b], 1), y


def test_nulls_go_with_high_values_in_one_node_and_low_values_in_another(spark):
    x, y = two_sided()
    oof = L.out_of_fold(table(spark, x, y), T.RoutedTrees(10, 3, rate=0.5), row_id="row_id", vec="vec", label="y", classes=(0, 1)).toPandas().sort_values("row_id")
    assert (oof.pred.to_numpy() == y).mean() > 0.98 and (oof.pred.to_numpy() == y)[np.isnan(x[:, 1])].all()
    fit = T.fit_routed(table(spark, x, y), T.RoutedTrees(10, 3, rate=0.5), vec="vec", target=F.col("y"), n_classes=2)
    cuts = [{bool(s) for f, c, s in zip(t.feature, t.cut, t.null_left) if f == 1 and np.isfinite(c)} for r in fit.rounds for t in r[0]]
    assert {True, False} in cuts  # one tree sends nulls to both sides


def test_first_tree_equals_a_direct_search(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    y = ((np.nan_to_num(x[:, 0], nan=9) + np.nan_to_num(x[:, 2], nan=-3) + rng.normal(size=400) * 2) > 9).astype(int)
    spec = T.RoutedTrees(rounds=1, depth=1, rate=1.0, min_rows=20)
    fit = T.fit_routed(table(spark, x, y), spec, vec="vec", target=F.col("y"), n_classes=2, fold="fold")
    for i, p in enumerate(fit.problems):
        own = np.arange(400) % 3 != p.fold
        v, t = x[own], y[own]
        w = (len(t) / (2 * np.bincount(t)))[t]
        g, h = w * (0.5 - t), w * 0.25
        found = []
        for j in range(3):
            for cut in [*np.unique(v[~np.isnan(v[:, j]), j])[:-1], np.inf]:
                for null_left in (True, False):
                    left = np.where(np.isnan(v[:, j]), null_left, v[:, j] <= cut)
                    if min(left.sum(), (~left).sum()) < 20:
                        continue
                    s = [g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left, left | True)]
                    found.append((s[0] + s[1] - s[2], j, cut, null_left))
        gain, j, cut, null_left = max(found)
        tree = fit.rounds[0][i][0]
        assert (tree.feature[0], tree.cut[0], bool(tree.null_left[0])) == (j, cut, null_left)
        left = np.where(np.isnan(v[:, j]), null_left, v[:, j] <= cut)
        assert np.allclose(tree.value[1:3], [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_written_scores_and_held_out_rows(spark, monkeypatch):
    x, y = two_sided(300, 4)
    c = y + (x[:, 0] > 0)
    df = table(spark, x, c)
    spec = T.RoutedTrees(5, 2, rate=0.3)
    plain = T.fit_routed(df, spec, vec="vec", target=F.col("y"), n_classes=3, fold="fold")
    monkeypatch.setattr(T, "REFRESH", 2)
    again = T.fit_routed(df.repartition(5), spec, vec="vec", target=F.col("y"), n_classes=3, fold="fold")
    moved = df.withColumn("vec", F.when(F.col("fold") == 0, F.transform("vec", lambda v: v * 50 - 7)).otherwise(F.col("vec")))
    other = T.fit_routed(moved, spec, vec="vec", target=F.col("y"), n_classes=3, fold="fold")
    for r, q, o in zip(plain.rounds, again.rounds, other.rounds):
        for i in range(3):
            for a, b in zip(r[i], q[i]):
                assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)
        assert all(np.allclose(a.value, b.value) and (a.feature == b.feature).all() for a, b in zip(r[0], o[0]))


def test_all_null_constant_and_nan_columns_and_defined_failures(spark):
    x, y = two_sided(240, 5)
    x = np.hstack([x, np.full((240, 1), np.nan), np.ones((240, 1))])
    df = table(spark, x, y).withColumn("vec", F.when(F.col("row_id") % 2 == 0, F.transform("vec", lambda v: F.coalesce(v, F.lit(float("nan"))))).otherwise(F.col("vec")))
    spec = T.RoutedTrees(4, 3, rate=0.5, min_rows=5)
    oof = L.out_of_fold(df, spec, row_id="row_id", vec="vec", label="y", classes=(0, 1)).toPandas()
    assert len(oof) == 240 and np.allclose([sum(p) for p in oof.proba], 1) and (oof.pred == oof.y).mean() > 0.95
    only = T.fit_routed(table(spark, x[:, 2:3], y), spec, vec="vec", target=F.col("y"), n_classes=2, fold="fold")
    assert all((t.feature < 0).all() for r in only.rounds for p in r for t in p)
    assert T.fit_routed(df.where("false"), spec, vec="vec", target=F.col("y"), n_classes=2, fold="fold").problems == []
    with pytest.raises(ValueError, match="no training row of class"):
        T.fit_routed(df.withColumn("y", F.lit(0)), spec, vec="vec", target=F.col("y"), n_classes=2, fold="fold")
    with pytest.raises(ValueError, match="bins"):
        T.fit_routed(df, T.RoutedTrees(bins=300), vec="vec", target=F.col("y"), n_classes=2)
