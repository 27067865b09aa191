"""Contracts that a query over the given tables does not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.notation import parse_substitution
from kinfold.functions.ranking import hash_rank, value_rank
from kinfold.functions.rows import attach_row
from kinfold.operators import resample, sequence, splits


def test_tagged_short_notation_is_found_anywhere(spark):
    texts = ["NP_000537.3:p.R175H", "p.R175H", "R175H", "xR175H", "NM_1:c.5G>A (p.Arg175His)", "p.R175*", "R175R", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", parse_substitution("t"))
    got = {r.i: tuple(r.s) if r.s else None for r in rows.collect()}
    hit = ("R", 175, "H")
    assert got == {0: hit, 1: hit, 2: hit, 3: None, 4: hit, 5: None, 6: None, 7: None}


@pytest.mark.parametrize(("groups", "held"), [(2, 1), (6, 1), (13, 1), (14, 2), (20, 3)])
def test_validation_share_is_truncated_and_leaves_a_group(spark, groups, held):
    rows = spark.createDataFrame([(g, 0) for g in range(groups)] + [(1000 + g, 1) for g in range(3)], "g long, fold int")
    out = splits.validation_groups(rows, group="g", fold="fold", n_folds=2, seed=1)
    assert out.where("fold = 1").count() == held


def test_an_infinite_level_is_not_adjudicated(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (0.9,)], "v double")
    rows = rows.withColumns({"lo": F.lit(0.8), "hi": F.lit(0.95), "off": F.lit(False)})
    got = [r[0] for r in rows.select(resample.level_verdict("v", "lo", "hi", "off", 0.5)).collect()]
    assert got[:4] == ["not adjudicated (no point estimate)"] * 4 and got[4].startswith("pass")


def test_a_rank_of_nan_names_the_cause(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "i long, v double")
    with pytest.raises(Exception, match="not a number"):
        value_rank(rows, [], "v").collect()


def test_totals_must_be_one_row(spark):
    rows = spark.createDataFrame([(1,), (2,)], "i int")
    assert attach_row(rows, rows.agg(F.sum("i").alias("s"))).count() == 2
    for wrong in (rows.select(F.col("i").alias("s")), rows.where("i > 5").select(F.col("i").alias("s"))):
        with pytest.raises(Exception, match="must be one row"):
            attach_row(rows, wrong).collect()


def test_a_wide_matrix_keeps_all_its_columns(spark, tmp_path):
    letters = [chr(0x100 + i) for i in range(70)]
    text = "# note\n  " + " ".join(letters) + "\n" + "".join(f"{a} " + " ".join(str(i * 70 + j) for j in range(70)) + "\n" for i, a in enumerate(letters))
    (tmp_path / "m.txt").write_text(text)
    got = sequence.read_substitution_matrix(spark, str(tmp_path / "m.txt"))
    assert got.count() == 4900 and got.agg(F.max("score")).first()[0] == 4899.0


def test_draw_buckets_stay_small_without_a_key(spark):
    ranked = hash_rank(spark.range(200_000).withColumnRenamed("id", "i"), [], ["i"], 3)
    assert np.array_equal(np.sort([r.rank for r in ranked.select("rank").collect()]), np.arange(200_000))
    sizes = spark.range(200_000).groupBy(F.substring(F.md5(F.concat_ws("|", F.lit("3"), F.col("id").cast("string"))), 1, 4)).count()
    assert sizes.agg(F.max("count")).first()[0] < 30
