"""Rank correlation in all draws at once: equal to one draw after another, without a shuffled row for each draw."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import draw_ranks
from kinfold.operators import resample as S


@pytest.mark.parametrize("rows", [1 << 14, 40])
def test_rank_correlation_of_all_draws_equals_single_draws(spark, monkeypatch, rows):
    monkeypatch.setattr(draw_ranks, "ROWS", rows)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"gene": rng.integers(0, 90, 900), "x": np.round(rng.normal(size=900), 1), "fold": 0})
    pdf["y"] = np.where(rng.random(900) < 0.4, 7.0, np.round(pdf["x"] + rng.normal(size=900), 1))  # one value holds two rows in five
    pdf["fold"] = pdf["gene"] % 2
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("x") != 0.5, F.col("y")))
    s = S.SpearmanRho("x", "y", "fold", 2)
    got = S.bootstrap_values(df, {"rho": s}, cluster="gene", n_boot=70, seed=1).toPandas().set_index("boot")["value"]
    table = S.cluster_draws(df.select("gene").distinct(), cluster="gene", n_boot=70, seed=1)
    weighted = s.compress(df, "gene").join(table, "gene").withColumn("_w", F.col("_w") * F.col("weight"))
    want = s.score(weighted, ["boot"]).toPandas().set_index("boot")["value"]
    assert len(got) == len(want) == 70 and np.allclose(got.sort_index(), want.sort_index(), atol=1e-12)


def test_a_constant_side_has_no_correlation(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("gene"), F.lit(0).alias("fold"), F.col("id").alias("x"), F.lit(3.0).alias("y"))
    for s in (S.SpearmanRho("x", "y", "fold", 1), S.SpearmanRho("y", "x", "fold", 1)):
        got = S.bootstrap_values(df, {"rho": s}, cluster="gene", n_boot=5, seed=1).toPandas()
        assert len(got) == 5 and got["value"].isna().all()


def test_draws_are_not_multiplied_with_cells_in_the_shuffle(spark):
    store = spark._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    df = spark.range(6000).select((F.col("id") % 600).alias("gene"), F.lit(0).alias("fold"), F.hash("id").alias("x"), F.hash("id", "id").alias("y"))
    before = written()
    assert S.bootstrap_values(df, {"rho": S.SpearmanRho("x", "y", "fold", 1)}, cluster="gene", n_boot=100, seed=1).count() == 100
    assert written() - before < 6000 * 100 / 5
