import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.catalog import load
from kinfold.catalog.registry import QUERIES
from kinfold.operators import factors
from kinfold.operators import models as L
from kinfold.operators import vectors as V
from kinfold.plans import bindings as B

load()
SMALL = "/root/testdata/sf0.001"


def hot_frame(spark, rng):
    """Group 0 holds most rows, exact copies among them; 40 groups of 1 to 9 rows beside it."""
    x = rng.normal(size=(900, 5)) * [3, 1, 0.5, 0.2, 0.1] + [5, 0, -2, 1, 0]
    x[100:300] = x[100]
    g = np.r_[np.zeros(700, int), np.repeat(np.arange(1, 41), [1, 2, 3, 4, 5, 6, 7, 8, 5, 9] * 4)]
    t = x @ rng.normal(size=5) + rng.normal(size=900)
    pdf = pd.DataFrame({"row_id": np.arange(900), "g": g, "vec": list(x.tolist()), "t": t})
    return spark.createDataFrame(pdf).repartition(7), x, g, t


@pytest.mark.parametrize("block_rows", [4096, 6, 1])
def test_factor_keeps_the_moments_of_groups_of_any_size(spark, block_rows):
    df, x, g, t = hot_frame(spark, np.random.default_rng(0))
    got = factors.group_factors(
        df, key="g", vec="vec", target="t", finish=lambda n, r: (n, len(r), (r.T @ r).ravel().tolist()), fields="n long, k long, m array<double>", block_rows=block_rows
    ).toPandas().set_index("g")
    assert len(got) == 41 and (got["k"] <= np.minimum(got["n"], 7)).all()
    for k in range(41):
        z = np.c_[np.ones((g == k).sum()), x[g == k], t[g == k]]
        assert got.loc[k, "n"] == len(z) and np.allclose(np.reshape(got.loc[k, "m"], (7, 7)), z.T @ z)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_axes_of_small_and_split_groups_match_a_decomposition(spark, block_rows):
    df, x, g, _ = hot_frame(spark, np.random.default_rng(1))
    got = V.principal_shares(df, group="g", vec="vec", block_rows=block_rows).toPandas().set_index("g")
    assert set(got.index) == {k for k in range(41) if (g == k).sum() >= 3}
    for k, row in got.iterrows():
        part = x[g == k]
        values, axes = np.linalg.eigh(np.cov(part.T, bias=True))
        assert row.n == len(part) and np.allclose(row.mean_vector, part.mean(0))
        assert np.allclose([row.pc1_share, row.pc2_share], values[::-1][:2] / values.sum())
        assert row.pc1_mean_abs == pytest.approx(abs(part.mean(0) @ axes[:, -1]))


def test_rows_without_a_whole_vector_or_key_take_no_part(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 5.0]), ("a", [0.0, 1.0]), ("a", None), ("a", [None, 1.0]), ("a", [float("nan"), 1.0]), ("a", [float("inf"), 1.0])]
    rows += [(None, [1.0, 1.0])] * 4 + [("same", [2.0, 2.0])] * 5 + [("two", [1.0, 0.0]), ("two", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, vec array<double>")
    got = V.principal_shares(df, group="g", vec="vec").toPandas().set_index("g")
    assert set(got.index) == {"a", "same"} and got.loc["a", "n"] == 3
    assert pd.isna(got.loc["same", "pc1_share"]) and list(got.loc["same", "mean_vector"]) == [2.0, 2.0]
    assert V.principal_shares(df.limit(0), group="g", vec="vec").count() == 0
    one = V.principal_shares(df.select("g", F.slice("vec", 1, 1).alias("vec")), group="g", vec="vec").where("g = 'a'").first()
    assert one.pc1_share == pytest.approx(1.0) and one.pc2_share is None


@pytest.mark.parametrize("block_rows", [4096, 32])
def test_left_out_groups_equal_direct_fits_with_a_hot_group(spark, block_rows):
    df, x, g, t = hot_frame(spark, np.random.default_rng(2))
    got = L.leave_group_out_ridge(df, group="g", vec="vec", target="t", keep=["row_id"], block_rows=block_rows).toPandas().set_index("row_id")["predicted"]
    sizes = np.bincount(g)
    assert set(got.index) == set(np.flatnonzero(sizes[g] >= 5))
    for k in np.flatnonzero(sizes >= 5):
        out = g == k
        m, s = x[~out].mean(0), x[~out].std(0)
        z = (x[~out] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(5), z.T @ (t[~out] - t[~out].mean()))
        assert np.allclose(got[np.flatnonzero(out)], (x[out] - m) / s @ w + t[~out].mean())


def test_left_out_ridge_needs_other_rows_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b", [float(i), 1.0], float(i)) for i in range(12)], "row_id int, g string, vec array<double>, t double")
    assert L.leave_group_out_ridge(df, group="g", vec="vec", target="t").count() == 0  # six others at most
    assert L.leave_group_out_ridge(df, group="g", vec="vec", target="t", min_training=6).count() == 12
    assert L.leave_group_out_ridge(df.limit(0), group="g", vec="vec", target="t").count() == 0


def test_no_matrix_of_a_group_is_shuffled(spark):
    df = hot_frame(spark, np.random.default_rng(3))[0]
    fits = factors.group_factors(df, key="g", vec="vec", target="t", finish=lambda n, r: (n,), fields="n long")
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan  # rows go to their group as they are


def test_wide_catalog_queries_against_direct_computation(spark):
    pdf = B.vectors(spark, SMALL).select("family", "vec").toPandas()
    x, fam = np.stack(pdf["vec"]), pdf["family"].to_numpy()
    t = x[:, 0] * 3 + x[:, 5]
    rho = QUERIES["m8_per_group_spearman"](spark, SMALL).toPandas().set_index("family")["rho"]
    for k in rho.index:
        out = fam == k
        m, s = x[~out].mean(0), x[~out].std(0)
        z = (x[~out] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (t[~out] - t[~out].mean()))
        assert rho[k] == pytest.approx(pd.Series((x[out] - m) / s @ w).rank().corr(pd.Series(t[out]).rank()))
    pairs = B.pairs(spark, SMALL).select("family", "wt", "mut").toPandas()
    delta, fam = np.stack(pairs["mut"]) - np.stack(pairs["wt"]), pairs["family"].to_numpy()
    got = QUERIES["v15_scan_axes"](spark, SMALL).toPandas().set_index("family")
    for k, row in got.iterrows():
        part = delta[fam == k]
        s = np.linalg.svd(part - part.mean(0), compute_uv=False) ** 2
        if len(part) >= 4:
            assert row.pc1_share == pytest.approx(s[0] / s.sum()) and row.pc1_pc2_ratio == pytest.approx(s[0] / s.sum() / (s[1] / s.sum() + 1e-8))
        else:
            assert pd.isna(row.pc1_share)
