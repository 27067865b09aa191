"""Networks trained over units: gradients, early stopping, held-back groups, partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import models as L
from kinfold.operators import networks as N


def table(spark, n=360, d=4, noise=0.0, seed=3):
    """Three classes by the largest of three sums; groups of six rows; a share of the labels is random."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.arange(1, d + 1) + 2).astype(np.float32).astype(float)
    y = np.argmax((x - 2) @ rng.normal(size=(d, 3)), axis=1)
    y = np.where(rng.random(n) < noise, rng.integers(0, 3, n), y)
    g = np.arange(n) // 6
    pdf = pd.DataFrame({"row_id": np.arange(n), "gene": g, "fold": g % 3, "vec": [v.tolist() for v in x], "y": y})
    df = spark.createDataFrame(pdf).select("row_id", "gene", F.col("fold").cast("int"), "vec", F.col("y").cast("int"))
    held = df.where("gene % 7 = 0").select("gene", "fold").distinct().withColumnRenamed("fold", "_own").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("fold"))).where("fold <> _own").select("fold", "gene")
    return df, held, x, y, g, pdf


def fitted(df, held, **options):
    return L.fit_folds(df, N.Network(**options), row_id="row_id", vec="vec", label="y", classes=(0, 1, 2), held=held, group="gene")


def loss(fit, i, x, y, weight_rows, rows):
    """Held-back loss of the kept network computed directly."""
    counts = np.bincount(y[weight_rows], minlength=3)
    w = (counts.sum() / (3 * counts))[y[rows]]
    z = (x[rows] - fit.mean[i]) / fit.scale[i]
    for j, (a, b) in enumerate(fit.layers[i]):
        z = z @ a + b
        z = np.maximum(z, 0) if j < len(fit.layers[i]) - 1 else z
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return float(w @ -np.log(p[np.arange(len(rows)), y[rows]]) / w.sum())


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    widths = [3, 5, 4, 3]
    flat = rng.normal(size=sum(a * b + b for a, b in zip(widths[:-1], widths[1:])))
    z, y, w = rng.normal(size=(7, 3)), rng.integers(0, 3, 7), rng.random(7) + 0.5
    got = N._flat(N.gradient(N._layers(flat, widths), z, y, w))

    def value(v):
        return w @ N.losses(N._layers(v, widths), z, y) / w.sum()

    step = np.eye(len(flat)) * 1e-6
    assert np.allclose(got, [(value(flat + s) - value(flat - s)) / 2e-6 for s in step], atol=1e-6)


def test_stops_early_and_keeps_the_best_epoch_though_the_last_is_worse(spark):
    df, held, x, y, g, pdf = table(spark, noise=0.6)
    fit = fitted(df, held, hidden=(32,), rate=0.02, dropout=0.0, decay=0.0, batch=32, max_epochs=60, patience=4).fit
    for i, p in enumerate(fit.problems):
        values = dict(fit.course[i])
        last = max(values)
        assert last < 60 and last == fit.kept[i] + 4
        assert values[fit.kept[i]] == min(v for e, v in values.items() if e) < values[last]
        training = pdf.fold.to_numpy() != p.fold
        back = np.flatnonzero(training & (g % 7 == 0))
        assert loss(fit, i, x, y, training, back) == pytest.approx(values[fit.kept[i]], abs=1e-9)


def test_standardised_by_trained_rows_and_blind_to_held_out_and_held_back_values(spark):
    df, held, x, y, g, pdf = table(spark)
    options = {"hidden": (8,), "max_epochs": 3, "patience": 3, "batch": 64}
    fit = fitted(df, held, **options).fit
    trained = (pdf.fold.to_numpy() != 0) & (g % 7 != 0)
    assert np.allclose(fit.mean[0], x[trained].mean(0)) and np.allclose(fit.scale[0], x[trained].std(0) + 1e-8)
    moved = df.withColumn("vec", F.when((F.col("fold") == 0), F.transform("vec", lambda v: v + 100.0)).otherwise(F.col("vec")))
    again = fitted(moved, held, **options).fit
    assert np.allclose(again.course[0], fit.course[0]) and not np.allclose(again.course[1], fit.course[1])
    back = df.withColumn("vec", F.when(F.col("gene") % 7 == 0, F.transform("vec", lambda v: v * 0.5)).otherwise(F.col("vec")))
    third = fitted(back, held, **{**options, "tolerance": -1e9}).fit  # any loss counts as better: the last epoch is kept
    same = fitted(df, held, **{**options, "tolerance": -1e9}).fit
    assert all(np.allclose(a[0], b[0]) for a, b in zip(third.layers[0], same.layers[0]))


def test_units_do_not_depend_on_partitions_and_are_averaged(spark, monkeypatch):
    df, held, *_ = table(spark)
    monkeypatch.setattr(N, "UNIT", 50)
    options = {"hidden": (8,), "max_epochs": 6, "patience": 6, "rate": 0.02, "batch": 16}
    one, many = (fitted(df.repartition(k), held, **options).fit for k in (1, 7))
    units = N.packed(df, row_id="row_id", vec="vec", target=F.col("y"), fold="fold", held=held, group="gene", folds=[0, 1, 2])
    assert units.count() > 4 and units.agg(F.sum("n")).first()[0] == 360
    for a, b in zip(one.course, many.course):
        assert np.allclose(a, b) and a[-1][1] < a[0][1]
    same_ids = N.packed(df.withColumn("row_id", F.lit(1)), row_id="row_id", vec="vec", target=F.col("y"), fold="fold", held=held, group="gene", folds=[0, 1, 2])
    assert same_ids.agg(F.max("n"), F.sum("n")).first()[:] == (100, 360)


def test_out_of_fold_finds_the_classes_and_covers_every_row(spark):
    df, held, x, y, *_ = table(spark)
    oof = L.out_of_fold(df, N.Network((32,), rate=0.02, dropout=0.1, batch=32, max_epochs=40), row_id="row_id", vec="vec", label="y", classes=(0, 1, 2), held=held, group="gene").toPandas().sort_values("row_id")
    assert len(oof) == 360 and np.allclose([sum(p) for p in oof.proba], 1)
    assert (oof.pred.to_numpy() == y).mean() > 0.85


def test_defined_failures(spark):
    df, held, *_ = table(spark)
    with pytest.raises(ValueError, match="held-back groups"):
        L.fit_folds(df, N.Network(), row_id="row_id", vec="vec", label="y", classes=(0, 1, 2))
    with pytest.raises(ValueError, match="holds no row back"):
        fitted(df, held.where("fold = 0"))
    with pytest.raises(ValueError, match="no training row of class"):
        fitted(df.withColumn("y", F.lit(0)), held)
    with pytest.raises(Exception, match="undeclared class"):
        fitted(df.withColumn("y", F.lit(5)), held)
    assert list(fitted(df.where("false"), held)) == []
