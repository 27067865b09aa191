import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinfold.functions import ranking as R


def awkward(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate(
        [rng.normal(size=n), 1 - 10 ** rng.uniform(-15, 0, n), 10 ** rng.uniform(-12, 12, n), -(10 ** rng.uniform(-12, 12, n)), [0.0, 1.0, -1.0, 0.5, 2.0, 1e300]]
    )


def test_value_bucket_never_decreases(spark):
    x = np.sort(awkward())
    pdf = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", R.value_bucket("x").alias("b")).toPandas().sort_values("x")
    assert (np.diff(pdf["b"].to_numpy()) >= 0).all()
    assert pdf["b"].nunique() > 2000


def test_prefix_sums_match_pandas_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(6000) < 0.6, 0, rng.integers(1, 9, 6000)), "v": np.round(rng.normal(size=6000), 2), "w": rng.integers(0, 4, 6000)})
    got = R.prefix_sums(spark.createDataFrame(pdf), ["k"], "v", {"s": F.col("w")}).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = pdf.groupby(["k", "v"], as_index=False)["w"].sum().sort_values(["k", "v"]).reset_index(drop=True)
    want["before"] = want.groupby("k")["w"].cumsum() - want["w"]
    assert (got["s"].to_numpy() == want["w"].to_numpy()).all()
    assert (got["s_before"].to_numpy() == want["before"].to_numpy()).all()
    assert (got["s_total"].to_numpy() == want.groupby("k")["w"].transform("sum").to_numpy()).all()


def test_value_rank_orders_ties_by_id(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000), "v": rng.integers(0, 4, 3000) / 3.0, "i": rng.permutation(3000)})
    for desc in (False, True):
        got = R.value_rank(spark.createDataFrame(pdf), ["k"], "v", tie="i", descending=desc).toPandas().sort_values("i")
        want = pdf.sort_values(["v", "i"], ascending=[not desc, True])
        want["r"] = want.groupby("k").cumcount()
        assert (got["rank"].to_numpy() == want.sort_values("i")["r"].to_numpy()).all()


def test_hash_rank_is_a_permutation_and_repeats(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 3)
    a = R.hash_rank(df, ["k"], ["id"], 7, total="n").toPandas()
    for _, g in a.groupby("k"):
        assert sorted(g["rank"]) == list(range(len(g))) and (g["n"] == len(g)).all()
    b = R.hash_rank(df.repartition(13), ["k"], ["id"], 7).toPandas()
    m = a.merge(b, on=["id", "k"], suffixes=("_a", "_b"))
    assert (m["rank_a"] == m["rank_b"]).all()


def test_array_split_matches_numpy(spark):
    for n, k in ((10, 3), (11, 5), (4, 6), (25, 5)):
        got = [r[0] for r in spark.range(n).select(R.array_split_part(F.col("id"), F.lit(n), k)).collect()]
        want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
        assert got == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 2001), "v": rng.normal(size=2001)})
    got = R.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().sort_values("k")
    want = pdf.groupby("k")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())
