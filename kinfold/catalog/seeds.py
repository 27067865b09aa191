"""A: across-seed reducers."""

from pyspark.sql import functions as F

from kinfold.catalog.metrics import rounded
from kinfold.catalog.registry import query
from kinfold.operators import metrics as M
from kinfold.operators import seeds as A
from kinfold.plans import bindings as B

C = B.CLASSES
SEEDS = [0, 1, 2, 3, 4]
# one value per (source, seed); some cells lack a seed, fail one, repeat one or hold an extra one
_REC = f"""{B.VARIANTS_SQL}, raw AS (SELECT source, CAST(gene % 6 AS INTEGER) AS seed, avg(score) / 1000 AS value FROM variants GROUP BY 1, 2),
    rec AS (SELECT source, seed, CASE WHEN source = 'MACHINERY' AND seed = 2 THEN NULL ELSE value END AS value, CASE WHEN source = 'FURNITURE' AND seed = 1 THEN 'failed' ELSE 'success' END AS status FROM raw
      WHERE (seed < 5 OR source = 'AUTOMOBILE') AND NOT (source = 'BUILDING' AND seed = 3)),
    d AS (SELECT s.source, t.seed, r.value, r.status, true AS requested FROM (SELECT DISTINCT source FROM rec) s CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS seed) t LEFT JOIN rec r USING (source, seed)
      UNION ALL SELECT source, seed, value, status, false FROM rec WHERE seed > 4),
    e AS (SELECT source, seed, value, requested, CASE WHEN NOT requested THEN 'unexpected_seed' WHEN status IS NULL THEN 'missing_seed' WHEN status = 'failed' THEN 'failed_seed' WHEN value IS NULL THEN 'invalid_value' END AS defect FROM d)"""


def records(spark, sf):
    raw = B.variants(spark, sf).groupBy("source", (F.col("gene") % 6).cast("int").alias("seed")).agg((F.avg("score") / 1000).alias("value"))
    return raw.where("(seed < 5 OR source = 'AUTOMOBILE') AND NOT (source = 'BUILDING' AND seed = 3)").select(
        "source", "seed", F.when(~((F.col("source") == "MACHINERY") & (F.col("seed") == 2)), F.col("value")).alias("value"),
        F.when((F.col("source") == "FURNITURE") & (F.col("seed") == 1), "failed").otherwise("success").alias("status"),
    )


_LISTS = "coalesce(list_aggregate(list_sort(list(seed) FILTER ({f})), 'string_agg', ','), '')"
_REASON = """CASE WHEN count(*) FILTER (defect = 'unexpected_seed') > 0 THEN 'unexpected_seed' WHEN count(*) FILTER (defect = 'missing_seed') > 0 THEN 'missing_seed'
      WHEN count(*) FILTER (defect = 'failed_seed') > 0 THEN 'failed_seed' WHEN count(*) FILTER (defect = 'invalid_value') > 0 THEN 'invalid_value' END"""


@query(
    "a1_seed_mean",
    f"""WITH {_REC} SELECT source, CASE WHEN count(defect) = 0 THEN 'available' ELSE 'unavailable' END AS state, {_REASON} AS reason, {_LISTS.format(f='defect IS NULL')} AS contributing, {_LISTS.format(f='defect IS NOT NULL')} AS affected,
    round(CASE WHEN count(defect) = 0 THEN avg(value) END, 6) AS mean, round(CASE WHEN count(defect) = 0 THEN stddev_samp(value) END, 6) AS spread FROM e GROUP BY source""",
)
def a1(spark, sf):
    m = A.seed_mean(records(spark, sf), seeds=SEEDS, value="value", keys=["source"], status="status")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rounded(m.select("source", "state", "reason", join("contributing_seeds").alias("contributing"), join("affected_seeds").alias("affected"), "mean", "spread"), "mean", "spread")


@query("a1_seed_defects", f"WITH {_REC} SELECT source, CAST(seed AS INTEGER) AS seed, requested, defect FROM e")
def a1_defects(spark, sf):
    return A.seed_defects(records(spark, sf), seeds=SEEDS, value="value", keys=["source"], status="status").select("source", "seed", "requested", "defect")


@query(
    "a2_seed_vote",
    f"""WITH {_REC} SELECT source, CASE WHEN count(defect) = 0 THEN 'available' ELSE 'unavailable' END AS state, CASE WHEN count(defect) = 0 THEN count(*) FILTER (value > 150) END AS n_supporting,
    CASE WHEN count(defect) = 0 THEN count(*) FILTER (value > 150) >= 3 END AS decision FROM e GROUP BY source""",
)
def a2(spark, sf):
    return A.seed_vote(records(spark, sf), seeds=SEEDS, value="value", threshold=150.0, minimum=3, comparison="greater_than", keys=["source"], status="status")


@query(
    "a3_paired_seed_difference",
    f"""WITH {_REC}, o AS (SELECT family % 5 AS k, source, CAST(gene % 6 AS INTEGER) AS seed, avg(gene_score) / 1000 AS vb FROM variants WHERE gene % 6 < 5 GROUP BY ALL), b AS (SELECT source, seed, avg(vb) AS vb FROM o GROUP BY ALL),
    j AS (SELECT source, seed, defect, CASE WHEN defect IS NULL THEN value - vb END AS diff FROM e LEFT JOIN b USING (source, seed))
    SELECT source, CASE WHEN count(defect) = 0 THEN 'available' ELSE 'unavailable' END AS state, {_REASON} AS reason, count(diff) AS n_seeds, round(CASE WHEN count(defect) = 0 THEN avg(diff) END, 6) AS mean, round(CASE WHEN count(defect) = 0 THEN stddev_samp(diff) END, 6) AS spread FROM j GROUP BY source""",
)
def a3(spark, sf):
    b = B.variants(spark, sf).where("gene % 6 < 5").groupBy((F.col("family") % 5).alias("k"), "source", (F.col("gene") % 6).cast("int").alias("seed")).agg((F.avg("gene_score") / 1000).alias("v"))
    b = b.groupBy("source", "seed").agg(F.avg("v").alias("value")).withColumn("status", F.lit("success"))
    return rounded(A.paired_seed_difference(records(spark, sf), b, seeds=SEEDS, value="value", keys=["source"], status="status"), "mean", "spread")


_CONF = B.predictions_sql() + f", c AS (SELECT source, CAST(row_id % 3 AS INTEGER) AS seed, label AS y, {B.PRED_SQL} AS pred, count(*) AS n FROM preds WHERE NOT (source = 'BUILDING' AND label = 'P' AND row_id % 3 = 1) GROUP BY ALL)"


def confusion_records(spark, sf):
    p = M.predicted(B.predictions(spark, sf), proba="proba", classes=C).where("NOT (source = 'BUILDING' AND label = 'P' AND row_id % 3 = 1)")
    return p.groupBy("source", (F.col("row_id") % 3).cast("int").alias("seed"), F.col("label").alias("y"), "pred").agg(F.count("*").alias("n"))


@query(
    "a4_seed_confusion",
    f"""WITH {_CONF}, r AS (SELECT source, seed, y, sum(n) AS row_n FROM c GROUP BY ALL), ok AS (SELECT source, CASE WHEN count(*) = 9 THEN 'available' ELSE 'unavailable' END AS state FROM r GROUP BY 1)
    SELECT source, y, pred, state, CASE WHEN state = 'available' THEN CAST(sum(n) AS BIGINT) END AS pooled, round(CASE WHEN state = 'available' THEN sum(n / row_n) / 3 END, 6) AS normalized_mean FROM c JOIN r USING (source, seed, y) JOIN ok USING (source) GROUP BY source, y, pred, state""",
)
def a4(spark, sf):
    return rounded(A.seed_confusion(confusion_records(spark, sf), seeds=[0, 1, 2], classes=C, keys=["source"]), "normalized_mean")


def seeded_predictions(spark, sf):
    """One prediction table per seed, the second one with gaps, repeats and altered labels."""
    base = B.variants(spark, sf)
    a = B.with_shares(base, "s0").withColumn("seed", F.lit(0))
    b = B.with_shares(base, "s1").withColumn("seed", F.lit(1))
    b = b.where("row_id % 100 <> 3").withColumn("label", F.when(F.col("row_id") % 90 == 7, "X").otherwise(F.col("label")))
    return a.unionByName(b).unionByName(b.where("row_id % 80 = 5"))


@query(
    "a5_prediction_defects",
    f"""WITH {B.VARIANTS_SQL}, d AS (SELECT CASE WHEN row_id % 100 = 3 THEN 'missing_row' WHEN row_id % 80 = 5 THEN 'duplicate_row' WHEN row_id % 90 = 7 THEN 'metadata_mismatch' END AS defect FROM variants) SELECT CAST(1 AS INTEGER) AS seed, defect, count(*) AS n FROM d WHERE defect IS NOT NULL GROUP BY 2""",
)
def a5(spark, sf):
    return A.prediction_defects(seeded_predictions(spark, sf), B.variants(spark, sf), seeds=[0, 1], row_id="row_id", proba="proba", same=["label", "gene"])


@query(
    "a5_average_predictions",
    f"""WITH {B.VARIANTS_SQL}, {B.shares_sql('variants', 's0', 'x0')}, {B.shares_sql('variants', 's1', 'x1')} SELECT row_id, (a.proba[1] + b.proba[1]) / 2 AS p0, (a.proba[3] + b.proba[3]) / 2 AS p2 FROM x0 a LEFT JOIN (SELECT * FROM x1 WHERE row_id % 100 <> 3) b USING (row_id)""",
)
def a5_average(spark, sf):
    base = B.variants(spark, sf)
    two = B.with_shares(base, "s0").withColumn("seed", F.lit(0)).unionByName(B.with_shares(base, "s1").withColumn("seed", F.lit(1)).where("row_id % 100 <> 3"))
    avg = A.average_predictions(two, row_id="row_id", proba="proba", n_classes=3, seeds=[0, 1])
    return avg.select("row_id", F.get("proba", F.lit(0)).alias("p0"), F.get("proba", F.lit(2)).alias("p2"))


_CELLS = B.VARIANTS_SQL + """, m AS (SELECT source, CAST(row_id % 5 AS INTEGER) AS seed, avg(score) / 1000 AS score, avg(gene_score) / 1000 AS gene_score FROM variants GROUP BY 1, 2),
    l AS (SELECT source, seed, 'score' AS metric, score AS v FROM m UNION ALL SELECT source, seed, 'gene_score', gene_score FROM m WHERE NOT (source = 'BUILDING' AND seed = 4))"""


def cells(spark, sf):
    m = B.variants(spark, sf).groupBy("source", (F.col("row_id") % 5).cast("int").alias("seed")).agg((F.avg("score") / 1000).alias("score"), (F.avg("gene_score") / 1000).alias("gene_score"))
    long = m.unpivot(["source", "seed"], ["score", "gene_score"], "metric", "value")
    return long.where("NOT (source = 'BUILDING' AND seed = 4 AND metric = 'gene_score')")


@query(
    "a6_seed_table",
    f"""WITH {_CELLS} SELECT source, metric, CASE WHEN count(*) = 5 THEN 'available' ELSE 'unavailable' END AS state, CASE WHEN count(*) < 5 THEN 'missing_seed' END AS reason, round(CASE WHEN count(*) = 5 THEN avg(v) END, 6) AS mean, round(CASE WHEN count(*) = 5 THEN stddev_samp(v) END, 6) AS spread FROM l GROUP BY 1, 2""",
)
def a6(spark, sf):
    m = A.seed_mean(cells(spark, sf), seeds=SEEDS, value="value", keys=["source", "metric"])
    return rounded(m.drop("contributing_seeds", "affected_seeds"), "mean", "spread")


@query("a7_read_cells", f"WITH {_CELLS} SELECT source, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS spread FROM l GROUP BY 1, 2 HAVING count(*) = 5")
def a7(spark, sf):
    m = A.seed_mean(cells(spark, sf), seeds=SEEDS, value="value", keys=["source", "metric"])
    return rounded(A.read_cell(m, inference=True).select("source", "metric", "mean", "spread"), "mean", "spread")


@query(
    "a8_permutation_vote",
    f"""WITH {_CELLS}, p AS (SELECT source, seed, v / 200 AS p FROM l WHERE metric = 'score') SELECT source, 'available' AS state, count(*) FILTER (p < 0.75) AS n_supporting, count(*) FILTER (p < 0.75) >= 3 AS decision FROM p GROUP BY source""",
)
def a8(spark, sf):
    p = cells(spark, sf).where("metric = 'score'").select("source", "seed", (F.col("value") / 200).alias("p"))
    return A.permutation_vote(p, seeds=SEEDS, p_value="p", alpha=0.75, keys=["source"])
