"""Learners of single folds read rows that were put together once."""

import pytest
from pyspark.sql import functions as F

from kinfold.operators import models as L


@pytest.mark.parametrize("estimator", [L.forest(2, 2), L.boosted(2, 2)])
def test_rows_are_put_together_once_for_all_folds(spark, estimator):
    made = spark.sparkContext.accumulator(0)

    def marked(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(240).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), F.concat(F.lit("c"), F.floor(F.col("id") / 3) % 3).alias("cls"))
    rows = rows.withColumn("x", F.substring("cls", 2, 1).cast("double")).mapInPandas(marked, "row_id long, fold int, cls string, x double").withColumn("vec", F.array("x", F.lit(1.0)))
    oof = L.out_of_fold(rows, estimator, row_id="row_id", vec="vec", label="cls", classes=("c0", "c1", "c2"), scale=False)
    assert oof.where("pred = cls").count() == 240
    assert made.value <= 2 * 240  # a checkpoint computes its rows, and writes them
