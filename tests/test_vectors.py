import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import neighbors as K
from kinfold.operators import vectors as V


def frame(spark, x, **cols):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "vec": [v.tolist() for v in x], **cols}))


@pytest.mark.parametrize("block_rows,n_pivots", [(4096, 4), (40, 6)])
def test_knn_matches_brute_force_with_a_crowded_cell(spark, block_rows, n_pivots):
    rng = np.random.default_rng(0)
    near = rng.normal(size=6) + 0.01 * rng.normal(size=(150, 6))  # a third of the rows sit together
    x = np.vstack([near, rng.normal(size=(250, 6)), near[:5]])  # and five exact copies
    df = frame(spark, x)
    got = K.knn_join(df, df, k=4, block_rows=block_rows, n_pivots=n_pivots).toPandas().sort_values(["query", "rank"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["neighbor"].to_numpy().reshape(-1, 4) == want).all()


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_knn_visits_few_pairs_of_clustered_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 3000)] + 0.02 * rng.normal(size=(3000, 8))
    df, stats = frame(spark, x), {}
    got = K.knn_join(df, df, k=5, block_rows=64, n_pivots=60, stats=stats).toPandas().sort_values(["query", "rank"])
    assert (got["neighbor"].to_numpy().reshape(-1, 5) == brute(x, 5)).all()
    assert stats["all_pairs"] == 9_000_000 and stats["pairs"] < stats["all_pairs"] / 5


def test_knn_of_copies_visits_the_first_shells_only(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 6))
    x[200:800] = x[200]  # half of the rows are one vector: the nearest are the smallest ids
    df, stats = frame(spark, x), {}
    got = K.knn_join(df, df, k=3, block_rows=50, n_pivots=20, stats=stats).toPandas().sort_values(["query", "rank"])
    assert (got["neighbor"].to_numpy().reshape(-1, 3) == brute(x, 3)).all()
    copies_alone = {}
    group = df.where("row_id BETWEEN 200 AND 799")
    K.knn_join(group, group, k=3, block_rows=50, n_pivots=4, stats=copies_alone).count()
    assert copies_alone["pairs"] <= 600 * 2 * 50 < copies_alone["all_pairs"] / 5


def test_knn_with_too_few_rows_other_queries_and_no_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 3))
    df = frame(spark, x)
    got = K.knn_join(df, df, k=9, block_rows=2).toPandas()
    assert len(got) == 30 and (got.groupby("query")["rank"].max() == 5).all()
    with_null = df.unionByName(spark.createDataFrame([(99, None)], df.schema))
    assert K.knn_join(with_null, with_null, k=9, block_rows=2).count() == 30
    assert K.knn_join(df, df.limit(0), k=2).count() == 0 and K.knn_join(df.limit(0), df, k=2).count() == 0
    far = K.knn_join(frame(spark, -x), df, k=1, exclude_self=False, block_rows=2, n_pivots=3).toPandas().sort_values("query")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (far["neighbor"].to_numpy() == (1 + u @ u.T).argmin(1)).all()


def test_closed_form_ratio_equals_pairwise(spark):
    rng = np.random.default_rng(1)
    x, fam = rng.normal(size=(60, 5)), rng.integers(0, 4, 60)
    got = V.within_between(frame(spark, x, family=fam), vec="vec", family="family").first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.triu_indices(60, 1)
    d, same = 1 - (u @ u.T)[i, j], fam[i] == fam[j]
    assert got.within_pairs == same.sum() and got.ratio == pytest.approx(d[same].mean() / (d[~same].mean() + 1e-10))


def test_principal_shares_match_a_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) * [3, 1, 0.5, 0.2] + 1
    got = V.principal_shares(frame(spark, x, g=np.arange(50) % 2), group="g", vec="vec").toPandas().set_index("g")
    for k in (0, 1):
        part = x[np.arange(50) % 2 == k]
        s = np.linalg.svd(part - part.mean(0), compute_uv=False) ** 2
        assert got.loc[k, "pc1_share"] == pytest.approx(s[0] / s.sum()) and got.loc[k, "pc2_share"] == pytest.approx(s[1] / s.sum())


def test_projection_leaves_no_variance(spark):
    rng = np.random.default_rng(3)
    x, basis = rng.normal(size=(80, 6)), rng.normal(size=(2, 6))
    out = V.project_out(frame(spark, x), vec="vec", basis=basis)
    assert V.residual_variance(out, vec="projected", basis=basis).first()[0] < 1e-12
    q = np.linalg.qr(basis.T)[0]
    got = np.stack(out.orderBy("row_id").toPandas()["projected"])
    assert np.allclose(got, x - x @ q @ q.T)


def test_principal_directions_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [4, 2, 1, 0.5, 0.1] + 7
    axes, share = V.principal_directions(frame(spark, x), vec="vec", k=2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(axes @ vt[:2].T), np.eye(2), atol=1e-6) and np.allclose(share, (s**2 / (s**2).sum())[:2])


def test_standardize_once_keeps_constant_columns(spark):
    x = np.array([[1.0, 5.0], [3.0, 5.0], [5.0, 5.0]])
    got = np.stack(V.standardize(frame(spark, x), vec="vec", training=F.lit(True), constant_scale=1.0).orderBy("row_id").toPandas()["scaled"])
    assert np.allclose(got[:, 1], 0) and np.allclose(got[:, 0], (x[:, 0] - 3) / x[:, 0].std())


def test_permuted_labels_are_permutations(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.normal(size=(90, 2)), label=np.arange(90) % 4)
    p = V.permuted_labels(df, row_id="row_id", label="label", n=3, seed=0).toPandas()
    assert len(p) == 270
    for _, g in p.groupby("perm"):
        assert sorted(g["label"]) == sorted(np.arange(90) % 4)
