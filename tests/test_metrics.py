import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import metrics as M


def brute_auroc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))


def brute_ap(y, s):
    out = 0.0
    for t in np.unique(s)[::-1]:
        at, above = s == t, s >= t
        out += y[at].sum() * y[above].mean()
    return out / y.sum()


def test_ranking_metrics_match_brute_force(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 900), "y": rng.integers(0, 2, 900), "s": np.round(rng.normal(size=900), 1)})
    got = M.ranking_metrics(spark.createDataFrame(pdf), y="y", score="s", keys=["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        y, s = g["y"].to_numpy(), g["s"].to_numpy()
        assert got.loc[k, "auroc"] == pytest.approx(brute_auroc(y, s))
        assert got.loc[k, "average_precision"] == pytest.approx(brute_ap(y, s))


def test_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 300), "s": np.round(rng.normal(size=300), 1), "t": rng.normal(size=300).round(1), "w": rng.integers(0, 5, 300)})
    many = pdf.loc[pdf.index.repeat(pdf["w"])]
    a, b = spark.createDataFrame(pdf), spark.createDataFrame(many)
    x = M.ranking_metrics(a, y="y", score="s", weight="w").first()
    z = M.ranking_metrics(b, y="y", score="s").first()
    assert x.auroc == pytest.approx(z.auroc) and x.average_precision == pytest.approx(z.average_precision)
    rho = M.spearman(a.where("w > 0"), [], x="s", y="t", weight="w").first()
    ranks = many[["s", "t"]].rank()
    assert rho.n == len(many) and rho.rho == pytest.approx(np.corrcoef(ranks["s"], ranks["t"])[0, 1])


def test_constant_target_has_no_ranking_metric(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    r = M.ranking_metrics(df, y="y", score="s").first()
    assert r.auroc is None and r.average_precision is None and r.n_neg == 0


def test_macro_f1_counts_absent_classes_as_zero_and_hides_balanced_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    r = M.class_metrics(df, y="y", pred="p", classes=("a", "b", "c")).first()
    assert r.macro_f1 == pytest.approx((2 / 3) / 3) and r.balanced_accuracy is None


def test_incomplete_folds_give_no_mean(spark):
    df = spark.createDataFrame([(0, 0.5), (1, None)], "fold int, m double")
    r = M.aggregate_folds(df, values=["m"], n_folds=2).first()
    assert r["mean"] is None and r.contributing == 1 and r.reason


def test_prevalence_cut_breaks_ties_by_row(spark):
    df = spark.createDataFrame([(i, int(i in (0, 3)), 0.5) for i in range(4)], "row_id long, y int, s double")
    r = M.prevalence_cut(df, y="y", score="s", row_id="row_id").first()
    assert r.flagged == 2 and r.ppv == 0.5 and r.npv == 0.5


def test_probability_one_is_in_no_calibration_bin(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.25)], "y int, p double")
    r = M.calibration_error(df, y="y", p="p").first()
    assert r.ece == pytest.approx(0.125) and r.n_binned == 1


def test_group_with_two_labels_raises(spark):
    df = spark.createDataFrame([("g", "a", [0.5, 0.5]), ("g", "b", [0.1, 0.9])], "g string, y string, p array<double>")
    with pytest.raises(Exception, match="more than one label"):
        M.group_vote(df, group="g", y="y", proba="p", classes=("a", "b")).collect()


def test_argmax_takes_the_first_declared_class_on_a_tie(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert M.predicted(df, proba="p", classes=("x", "y", "z")).first().pred == "x"


def test_auroc_at_median(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(9)], "y double, s double")
    assert M.auroc_at_median(df, y="y", score="s").first().auroc == 1.0
    assert F is not None
