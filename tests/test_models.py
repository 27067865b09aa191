import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.plans import studies as D


def data(spark, n=240, d=5, seed=0, signal=2.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 3
    t = x @ np.linspace(1, -1, d) + rng.normal(size=n) * 0.3
    y = (x[:, 0] * signal + rng.normal(size=n) > 3 * signal).astype(int)
    g = np.arange(n) // 6
    pdf = pd.DataFrame({"row_id": np.arange(n), "gene": g, "fold": g % 3, "vec": [v.tolist() for v in x], "t": t, "y": y})
    return spark.createDataFrame(pdf).withColumn("fold", F.col("fold").cast("int")).withColumn("y", F.col("y").cast("int")), x, t, pdf


def ridge(x, t, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (t - t.mean()))
    return lambda v: (v - m) / s @ w + t.mean()


def test_fold_ridge_equals_direct_fits(spark):
    df, x, t, pdf = data(spark)
    got = L.ridge_folds(df, vec="vec", target="t", keep=["row_id"]).toPandas().set_index("row_id")["predicted"]
    for f in range(3):
        te = (pdf.fold == f).to_numpy()
        assert np.allclose(got[np.flatnonzero(te)], ridge(x[~te], t[~te], 1.0)(x[te]))


def test_leave_group_out_ridge_equals_direct_fits_and_skips_small_groups(spark):
    df, x, t, pdf = data(spark)
    df = df.withColumn("gene", F.when(F.col("row_id") < 3, -1).otherwise(F.col("gene").cast("int")))
    got = L.leave_group_out_ridge(df, group="gene", vec="vec", target="t", min_rows=4, keep=["row_id"]).toPandas().set_index("row_id")["predicted"]
    assert not set(range(6)) & set(got.index)
    te = (pdf.gene == 7).to_numpy()
    assert np.allclose(got[np.flatnonzero(te)], ridge(x[~te], t[~te], 1.0)(x[te]))


def test_penalty_choice_equals_direct_leave_one_out(spark):
    df, x, t, pdf = data(spark, n=90)
    got = L.choose_alpha(df, vec="vec", target="t", alphas=(0.1, 10.0)).toPandas()
    for f in range(3):
        tr = (pdf.fold != f).to_numpy()
        z = (x[tr] - x[tr].mean(0)) / x[tr].std(0)
        for a in (0.1, 10.0):
            e = 0.0
            for i in range(len(z)):
                k = np.arange(len(z)) != i
                m, tm = z[k].mean(0), t[tr][k].mean()
                w = np.linalg.solve((z[k] - m).T @ (z[k] - m) + a * np.eye(5), (z[k] - m).T @ (t[tr][k] - tm))
                e += (t[tr][i] - ((z[i] - m) @ w + tm)) ** 2
            row = got[(got.fold == f) & (got.alpha == a)].iloc[0]
            assert row.error == pytest.approx(e, rel=1e-4)
    assert (got.groupby("fold")["chosen"].sum() == 1).all()


def test_pls_with_all_components_is_least_squares(spark):
    df, x, t, pdf = data(spark)
    got = L.pls_sweep(df, vec="vec", target="t", components=(1, 5), keep=["row_id"]).toPandas()
    te = (pdf.fold == 0).to_numpy()
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.linalg.lstsq(z[~te], t[~te], rcond=None)[0]
    full = got[(got.fold == 0) & (got.n_components == 5)].set_index("row_id")["predicted"]
    assert np.allclose(full[np.flatnonzero(te)], z[te] @ w)


def test_logistic_finds_a_planted_signal_and_covers_every_row(spark):
    df, *_ = data(spark)
    oof = L.out_of_fold(df, L.logistic(), row_id="row_id", vec="vec", label="y", classes=(0, 1))
    auc = M.ranking_metrics(oof.withColumn("p", F.get("proba", F.lit(1))), y="y", score="p").first().auroc
    cover = L.oof_coverage(oof, df, row_id="row_id").first()
    assert auc > 0.9 and (cover.n_rows, cover.n_missing, cover.n_repeated) == (240, 0, 0)


def test_projection_last_removes_the_signal(spark):
    df, *_ = data(spark, signal=5.0)
    out = D.direction_ablation(df, row_id="row_id", vec="vec", label="y", k_max=1).groupBy("removed").agg(F.avg("auroc").alias("a")).toPandas().set_index("removed")["a"]
    assert out[0] > 0.9 and out[1] < 0.75


def test_missing_training_class_raises(spark):
    df, *_ = data(spark)
    with pytest.raises(ValueError, match="no training row"):
        L.out_of_fold(df.withColumn("y", (F.col("fold") == 1).cast("int")), L.logistic(), row_id="row_id", vec="vec", label="y", classes=(0, 1))


def test_align_proba(spark):
    df = spark.createDataFrame([([0.7, 0.3],)], "p array<double>")
    assert L.align_proba(df, proba="p", given=["b", "a"], declared=["a", "b", "c"]).first().p == [0.3, 0.7, 0.0]
    for options in ({"given": ["a", "z"], "declared": ["a", "b"]}, {"given": ["a"], "declared": ["a", "b"], "missing": "error"}):
        with pytest.raises(ValueError, match="classes differ"):
            L.align_proba(df, proba="p", **options)


def test_cascade_shares_sum_to_one(spark):
    df, *_ = data(spark)
    rows = df.withColumn("cls", F.when(F.col("y") == 1, "LOF").when(F.col("row_id") % 2 == 0, "GOF").otherwise("DN")).withColumn("family", F.col("gene") % 5)
    out = L.cascade(rows, row_id="row_id", vec="vec", label="cls", family="family", classes=("GOF", "DN", "LOF"), arm="family_matched", n_clusters=2).toPandas()
    assert np.allclose([sum(p) for p in out.proba], 1) and len(out) == 240


def test_family_fits_equal_a_direct_fit(spark):
    df, *_ = data(spark)
    rows = df.withColumn("fam", F.col("gene") % 2).withColumn("fold", F.pmod(F.floor(F.col("gene") / 2), F.lit(3)).cast("int"))
    got = {r.fam: np.array(r.fits).reshape(3, -1) for r in D.family_fits(rows, family="fam", fold="fold", vec="vec", y="y", n_folds=3).collect()}
    local = rows.toPandas()
    for fam, fits in got.items():
        for k in range(3):
            part = local[(local.fam == fam) & (local.fold != k)]
            x, t = np.stack(part.vec), part.y.to_numpy()
            mean, scale = x.mean(0), x.std(0) + 1e-8
            z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            w = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
            b, ridge = np.zeros(z.shape[1]), np.diag([1.0] * (z.shape[1] - 1) + [1e-8])
            for _ in range(50):
                p = 1 / (1 + np.exp(-z @ b))
                b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - t)) + ridge @ b)
            assert np.allclose(fits[k, -len(b) :], b, atol=1e-6)


def test_family_fits_say_whether_they_converged_and_damp_their_steps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)) * [1, 30, 0.01]
    y = (x[:, 0] + 0.3 * rng.normal(size=240) > 1.9).astype(int)  # few rows of class 1, nearly separable
    pdf = pd.DataFrame({"fam": np.arange(240) % 2, "fold": np.arange(240) // 2 % 3, "vec": x.tolist(), "y": y})
    df = spark.createDataFrame(pdf)
    options = {"family": "fam", "fold": "fold", "vec": "vec", "y": "y", "n_folds": 3}
    assert not any(r.converged for r in D.family_fits(df, steps=2, **options).collect())
    for r in D.family_fits(df, **options).collect():
        assert r.converged
        for k, fit in enumerate(np.array(r.fits).reshape(3, -1)):
            use = (pdf.fam == r.fam) & (pdf.fold != k)
            z = np.hstack([(x[use] - fit[:3]) / fit[3:6], np.ones((use.sum(), 1))])
            w = np.where(y[use] == 1, fit[7], fit[6])
            gradient = z.T @ (w * (1 / (1 + np.exp(-z @ fit[8:])) - y[use])) + fit[8:] * [1, 1, 1, 1e-8]
            assert np.abs(gradient).max() < 1e-5


def pooled_rows(rng, signal):
    """Three families of 12 genes of 6 rows: genes of folds 0 to 2 hold both classes; scores of a family have their own offset."""
    g = np.repeat(np.arange(36), 6)
    y = np.tile([0, 0, 0, 0, 1, 1], 36)
    score = signal * y + rng.normal(size=len(g)) + 50.0 * (g // 12)
    return pd.DataFrame({"fam": g // 12, "gene": g, "fold": g % 3, "y": y, "score": score})


def test_pooled_score_ranks_inside_each_family_and_fold(spark):
    pdf = pooled_rows(np.random.default_rng(6), 2.0)
    options = {"family": "fam", "gene": "gene", "fold": "fold", "y": "y", "score": "score", "n_folds": 3, "n_boot": 200}
    got = D.pooled_within_family(spark.createDataFrame(pdf), **options).first()
    each = []
    for _, b in pdf.groupby(["fam", "fold"]):
        a, c = b.score[b.y == 1].to_numpy()[:, None], b.score[b.y == 0].to_numpy()
        each.append(((a > c) + 0.5 * (a == c)).mean())
    assert (got.n_families, got.n_rows, got.n_genes, got.n_positive) == (3, 216, 36, 72)
    assert got.point == pytest.approx(np.mean(each)) and 0.5 < got.ci_low <= got.point <= got.ci_high and got.n_resamples == 200
    none = D.pooled_within_family(spark.createDataFrame(pooled_rows(np.random.default_rng(7), 0.0)), **options).first()
    assert none.ci_low < 0.5 < none.ci_high


def test_pooled_score_needs_every_fold_and_a_family_with_both_classes(spark):
    pdf = pooled_rows(np.random.default_rng(8), 1.0)
    options = {"family": "fam", "gene": "gene", "fold": "fold", "y": "y", "score": "score", "n_folds": 3, "n_boot": 20}
    lacking = pdf.assign(y=np.where((pdf.fam == 1) & (pdf.fold == 2), 0, pdf.y))
    assert D.pooled_within_family(spark.createDataFrame(lacking), **options).first().point is None
    without = D.pooled_within_family(spark.createDataFrame(pdf.assign(y=np.where(pdf.fam == 2, 0, pdf.y))), **options).first()
    assert without.n_families == 2 and without.n_genes == 24 and without.point is not None
    empty = D.pooled_within_family(spark.createDataFrame(pdf.assign(y=0)), **options).first()
    assert empty.n_families == 0 and empty.point is None and empty.ci_suppressed


def test_importance_ranks_the_signal_first(spark):
    df, *_ = data(spark, signal=5.0)
    fitted = L.fit_folds(df, L.logistic(), row_id="row_id", vec="vec", label="y", classes=(0, 1), scale=False)
    top = L.permutation_importance(df, fitted[0][1], row_id="row_id", vec="vec", names=list("abcde"), label="y", classes=(0, 1), repeats=3).first()
    assert top.feature == "a"
