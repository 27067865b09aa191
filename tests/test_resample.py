import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import resample as S


def test_draws_keep_the_cluster_count_per_stratum(spark):
    c = spark.createDataFrame([(f"g{i}", "a" if i < 5 else "b") for i in range(20)], "gene string, stratum string")
    d = S.cluster_draws(c, cluster="gene", n_boot=30, seed=1).join(c, "gene")
    per = d.groupBy("boot", "stratum").agg(F.sum("weight").alias("w")).toPandas()
    assert len(per) == 60 and set(per[per.stratum == "a"].w) == {5} and set(per[per.stratum == "b"].w) == {15}


def test_subsample_has_no_repeats(spark):
    c = spark.range(50).select(F.col("id").alias("gene"))
    d = S.cluster_subsamples(c, cluster="gene", n_boot=10, seed=0).toPandas()
    assert (d.groupby("boot")["gene"].nunique() == 32).all() and len(d) == 320


def arm(spark, signal, seed):
    rng = np.random.default_rng(seed)
    y = np.tile([0, 1], 300)
    return spark.createDataFrame(
        pd.DataFrame({"row_id": np.arange(600), "gene": np.arange(600) // 6, "fold": (np.arange(600) // 6) % 3, "y": y, "s": y * signal + np.round(rng.normal(size=600), 3)})
    )


def test_planted_difference_excludes_zero_and_none_covers_it(spark):
    a, b = arm(spark, 1.5, 0), arm(spark, 0.2, 1)
    stat = S.BinaryAuroc("y", "s", "fold", 3)
    d = S.paired_difference(a, b, stat, stat, cluster="gene", n_boot=60).first()
    assert d.point > 0.2 and d.ci_low > 0
    same = S.paired_difference(a, a, stat, stat, cluster="gene", n_boot=20).first()
    assert same.point == 0 and same.ci_low == 0 and same.ci_high == 0


def test_bootstrap_value_equals_physically_repeated_rows(spark):
    a = arm(spark, 0.8, 3)
    stat = S.BinaryAuroc("y", "s", "fold", 3)
    got = S.bootstrap_values(a, {"auc": stat}, cluster="gene", n_boot=4, seed=9).toPandas().set_index("boot")["value"]
    draws = S.cluster_draws(a.select("gene").distinct(), cluster="gene", n_boot=4, seed=9).toPandas()
    pdf = a.toPandas()
    for boot, g in draws.groupby("boot"):
        rows = pdf.merge(g, on="gene")
        rows = rows.loc[rows.index.repeat(rows["weight"])]
        folds = []
        for _, f in rows.groupby("fold"):
            p, n = f.loc[f.y == 1, "s"].to_numpy(), f.loc[f.y == 0, "s"].to_numpy()
            folds.append(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))
        assert got[boot] == pytest.approx(np.mean(folds))


def test_a_draw_with_an_undefined_fold_is_discarded_whole(spark):
    rows = [(g, g % 2, int(g == 0 or g % 2), float(g)) for g in range(8)]
    df = spark.createDataFrame(rows, "gene int, fold int, y int, s double")
    out = S.bootstrap_interval(df, {"auc": S.BinaryAuroc("y", "s", "fold", 2)}, cluster="gene", n_boot=40, seed=0).first()
    assert out.n_discarded > 0 and out.ci_suppressed and out.ci_low is None


def test_percentiles_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=200)
    r = S.percentile_summary(spark.createDataFrame(pd.DataFrame({"value": x})), value="value", n_boot=200).first()
    assert np.allclose([r.ci_low, r.ci_high], np.percentile(x, [2.5, 97.5]))


def test_strata_are_unavailable_when_a_cluster_spans_folds(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("b", 0, "y")], "c string, fold int, label string")
    assert S.class_presence_strata(df, cluster="c", folds=["fold"], label="label").where("stratum IS NOT NULL").count() == 0


def test_permutation_keeps_labels_inside_folds(spark):
    pdf = pd.DataFrame({"g": np.arange(60), "fold": np.arange(60) % 3})
    pdf["label"] = np.where(pdf.g % 4 == 0, "x", "y")
    df = spark.createDataFrame(pdf).withColumn("fold", F.col("fold").cast("int"))
    p = S.permute_within_folds(df, unit="g", label="label", fold="fold", n=5, seed=0).toPandas()
    want = pdf.groupby("fold")["label"].apply(lambda s: sorted(s))
    for (_, fold), g in p.groupby(["perm", "fold"]):
        assert sorted(g["label"]) == want[fold]
    merged = p.merge(pdf, on="g")
    assert (merged["label_x"] != merged["label_y"]).any()
    with pytest.raises(Exception, match="two folds"):
        S.permute_within_folds(df.unionByName(df.withColumn("fold", F.col("fold") + 1)), unit="g", label="label", fold="fold", n=1, seed=0).collect()


def test_cluster_blocks_move_whole_and_alone_ones_stay(spark):
    rows = [(f"g{c}{m}", f"c{c}", 0, "L" if c == 9 else f"l{c}{m}") for c, size in ((1, 2), (2, 2), (3, 2), (9, 3)) for m in range(size)]
    df = spark.createDataFrame(rows, "g string, c string, fold int, label string")
    p = S.permute_cluster_blocks(df, group="g", label="label", cluster="c", fold="fold", n=6, seed=3).toPandas()
    assert (p[p.g.str.startswith("g9")]["label"] == "L").all()
    for perm, part in p.groupby("perm"):
        assert len(part) == 9
        blocks = {k[1]: tuple(v.sort_values("g")["label"].str[1]) for k, v in part[~part.g.str.startswith("g9")].groupby(part.g.str[:2])}
        assert sorted(b[0] for b in blocks.values()) == ["1", "2", "3"] and all(len(set(b)) == 1 for b in blocks.values())
    assert S.immovable_clusters(df, group="g", cluster="c", fold="fold").count() == 1


def test_planted_signal_has_a_small_p_value(spark):
    df = arm(spark, 2.0, 5).withColumn("p", F.array(-F.col("s"), F.col("s")))
    t = S.auroc_permutation_test(df, row_id="row_id", y="y", proba="p", classes=(0, 1), fold="fold", n_folds=3, n=19, seed=0).first()
    assert t.p_value == pytest.approx(0.05) and t.resolution_limited and abs(t.null_mean - 0.5) < 0.05


def test_standard_score_reasons(spark):
    obs = spark.createDataFrame([(1.0,)], "o double")
    z = lambda v, k: S.null_standard_score(obs, spark.createDataFrame([(x,) for x in v], "v double"), observed="o", value="v", expected=k).first()
    assert z([0.0, 1.0, 2.0], 3).z_score == 0
    assert z([0.0, 1.0], 3).reason == "incomplete_null_draws"
    assert z([0.0, None, 1.0], 3).reason == "invalid_or_insufficient_null_draws"
    assert z([1.0, 1.0, 1.0], 3).reason == "zero_null_draw_spread"


def test_arms_that_disagree_on_a_label_raise(spark):
    a = spark.createDataFrame([(1, "x", "p", 0)], "row_id int, label string, pred string, fold int")
    b = a.withColumn("label", F.lit("z"))
    with pytest.raises(Exception, match="disagree"):
        S.pair_arms(a, b, row_id="row_id", label="label", keep=[], value="pred").collect()


def test_ties_and_groups_across_chunks(spark):
    from kinfold.operators import many_draws as D

    rng = np.random.default_rng(8)
    n, draws = 400, 7
    score, y, k = rng.integers(0, 9, n) / 8.0, rng.integers(0, 2, n), rng.integers(0, 3, n)
    w = rng.integers(0, 3, (n, draws))
    pdf = pd.DataFrame({"k": k, "s": score, "_w": 1.0, "_mode": y, "_draws": [np.flatnonzero(r).tolist() for r in w], "_counts": [r[r > 0].astype(float).tolist() for r in w]})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = D.auroc_by_draw(spark.createDataFrame(pdf), keys=["k"], score="s", n_draws=draws).toPandas().set_index(["k", "draw"])["auroc"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    for g in range(3):
        for d in range(draws):
            rows = np.repeat(np.arange(n), np.where(k == g, w[:, d], 0))
            p, q = score[rows][y[rows] == 1], score[rows][y[rows] == 0]
            assert got[(g, d)] == pytest.approx(((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)))


def test_the_whole_log_has_its_intervals(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    log = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value").toPandas()
    log.loc[log.event_id % 150 == 0, "value"] = np.nan
    got = {r.gene: r for r in entry.queries()["r10_percentile_summary_all"](spark, sf).collect()}
    assert set(got) == set(log.user_id) and max(got) >= 40
    for gene, values in log.groupby("user_id")["value"]:
        v, r = values.dropna().to_numpy(), got[gene]
        ok = len(v) / 60 >= 0.99
        assert (r.n_resamples, r.n_discarded, r.ci_suppressed) == (len(v), 60 - len(v), not ok)
        assert (r.ci_low, r.ci_high) == (pytest.approx(tuple(np.percentile(v, [2.5, 97.5])), abs=1e-5) if ok else (None, None))
