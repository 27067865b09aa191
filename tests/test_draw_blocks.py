"""Draws in blocks: the same values as one draw after another, from rows that no draw shuffles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import draw_blocks
from kinfold.operators import resample as S


def _frame(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"gene": rng.integers(0, 60, 900), "x": np.round(rng.normal(size=900), 1), "label": rng.choice(list("abc"), 900)})
    pdf["y"] = np.where(rng.random(900) < 0.4, 7.0, np.round(pdf["x"] + rng.normal(size=900), 1))  # one value holds two rows in five
    pdf["fold"], pdf["pred"] = pdf["gene"] % 2, rng.choice(list("abc"), 900)
    pdf["proba"] = [[v, 0.5, 1 - v] for v in np.where(rng.random(900) < 0.4, 0.25, np.round(rng.random(900), 2))]
    return spark.createDataFrame(pdf).withColumn("y", F.when(F.col("x") != 0.5, F.col("y")))


def _singly(s, df, n_boot, seed, strata=None):
    clusters = S._clusters(df, "gene", strata)
    table = S.cluster_draws(clusters, cluster="gene", n_boot=n_boot, seed=seed)
    weighted = s.compress(df, "gene").join(table, "gene").withColumn("_w", F.col("_w") * F.col("weight"))
    return s.score(weighted, ["boot"]).toPandas().set_index("boot")["value"].sort_index()


STATISTICS = {
    "rho": S.SpearmanRho("x", "y", "fold", 2),
    "macro_f1": S.MacroF1("label", "pred", ("a", "b", "c"), "fold", 2),
    "macro_auroc": S.MacroAuroc("label", "proba", ("a", "b", "c"), "fold", 2),
}


@pytest.mark.parametrize("name", STATISTICS)
@pytest.mark.parametrize("pack", [1 << 16, 7])
@pytest.mark.parametrize("held", [1 << 27, 150])
def test_all_draws_equal_single_draws(spark, monkeypatch, name, pack, held):
    monkeypatch.setattr(draw_blocks, "PACK", pack)
    monkeypatch.setattr(draw_blocks, "HELD", held)
    df, s = _frame(spark), STATISTICS[name]
    strata = S.class_presence_strata(df, cluster="gene", folds=["fold"], label="label") if pack == 7 else None
    got = S.bootstrap_values(df, {name: s}, cluster="gene", n_boot=12, seed=1, strata=strata).toPandas().set_index("boot")["value"].sort_index()
    want = _singly(s, df, 12, 1, strata)
    assert list(got.index) == list(want.index) == list(range(12)) and np.allclose(got, want, atol=1e-12)
    point = S.bootstrap_interval(df, {name: s}, cluster="gene", n_boot=3, seed=1, strata=strata).first().point
    assert point == pytest.approx(S._point(s, s.compress(df, "gene")).first().point, abs=1e-12)


def test_a_key_too_large_for_a_task_is_ranked_in_buckets(spark, monkeypatch):
    df, s = _frame(spark), STATISTICS["rho"]
    monkeypatch.setattr(draw_blocks, "RANKED", 100)
    got = S.bootstrap_values(df, {"rho": s}, cluster="gene", n_boot=9, seed=2).toPandas().set_index("boot")["value"].sort_index()
    assert np.allclose(got, _singly(s, df, 9, 2), atol=1e-12) and len(got) == 9


@pytest.mark.parametrize("name", STATISTICS)
def test_what_is_shuffled_does_not_grow_with_the_draws(spark, name):
    store = spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    df = spark.range(20000).select((F.col("id") % 3000).alias("gene"), (F.col("id") % 2).alias("fold"), F.hash("id").alias("x"), F.hash("id", "id").alias("y"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("proba"),
                                   F.get(F.split(F.lit("a,b,c"), ","), (F.col("id") % 3).cast("int")).alias("label"), F.get(F.split(F.lit("a,b,c"), ","), F.floor(F.rand(4) * 3).cast("int")).alias("pred")).localCheckpoint()
    sizes = []
    for n_boot in (20, 300):
        last = max(stages())  # the store forgets old stages
        assert S.bootstrap_values(df, {name: STATISTICS[name]}, cluster="gene", n_boot=n_boot, seed=1).count() == n_boot
        sizes.append(sum(v for k, v in stages().items() if k > last))
    assert sizes[1] - sizes[0] < 0.2 * 280 * 3000  # results by key; about a byte for each cluster and draw before
