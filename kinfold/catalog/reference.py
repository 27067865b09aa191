"""B: reference predictors without features."""

from pyspark.sql import functions as F

from kinfold.catalog.metrics import class_metrics_sql, rounded
from kinfold.catalog.registry import query
from kinfold.operators import metrics as M
from kinfold.operators import reference as R
from kinfold.operators import resample as S
from kinfold.plans import bindings as B

C = B.CLASSES
P = B.predictions_sql()
_OWN = "{n} AS (SELECT {k} fold, count(*) FILTER (label = 'F') AS o0, count(*) FILTER (label = 'O') AS o1, count(*) FILTER (label = 'P') AS o2 FROM preds GROUP BY ALL)"
_TRAIN = (
    _OWN.format(n="own", k="")
    + """, tr AS (SELECT fold, CAST((SELECT sum(o0) FROM own) - o0 AS BIGINT) AS c0, CAST((SELECT sum(o1) FROM own) - o1 AS BIGINT) AS c1, CAST((SELECT sum(o2) FROM own) - o2 AS BIGINT) AS c2 FROM own)"""
)
_MAJ = "CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'F' WHEN c1 >= c2 THEN 'O' ELSE 'P' END"
_SHARE = "c{i}::DOUBLE / (c0 + c1 + c2)"


def rows(spark, sf):
    return B.predictions(spark, sf).drop("proba")


def _p(df, *keep):
    return df.select(*keep, "pred", *[F.round(F.get("proba", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


@query(
    "b1_majority_reference",
    f"WITH {P}, {_TRAIN} SELECT row_id, fold, {_MAJ} AS pred, round({_SHARE.format(i=0)}, 6) AS p0, round({_SHARE.format(i=1)}, 6) AS p1, round({_SHARE.format(i=2)}, 6) AS p2 FROM preds JOIN tr USING (fold)",
)
def b1(spark, sf):
    return _p(R.majority_reference(rows(spark, sf), label="label", classes=C), "row_id", "fold")


@query(
    "b1_majority_floor",
    f"WITH {P}, {_TRAIN}, q AS (SELECT fold, label, {_MAJ} AS pred FROM preds JOIN tr USING (fold)) SELECT fold, n, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM ({class_metrics_sql('q', 'fold')})",
)
def b1_floor(spark, sf):
    f = R.floor_by_fold(rows(spark, sf), label="label", classes=C).select("fold", "n", "macro_f1", "balanced_accuracy")
    return rounded(f, "macro_f1", "balanced_accuracy")


@query(
    "b2_stratified_reference",
    f"""WITH {P}, {_TRAIN}, u AS (SELECT row_id, fold, label, {B.h_sql(5, 'row_id')} / 4294967296.0::DOUBLE AS u, {_SHARE.format(i=0)} AS p0, {_SHARE.format(i=1)} AS p1 FROM preds JOIN tr USING (fold))
    SELECT row_id, CASE WHEN u < p0 THEN 'F' WHEN u < p0 + p1 THEN 'O' ELSE 'P' END AS pred FROM u""",
)
def b2(spark, sf):
    return R.stratified_reference(rows(spark, sf), row_id="row_id", label="label", classes=C, seed=5).select("row_id", "pred")


@query(
    "b3_family_frequency_reference",
    f"""WITH {P}, {_TRAIN}, {_OWN.format(n='fo', k='family,')}, ft AS (SELECT family, sum(o0) AS t0, sum(o1) AS t1, sum(o2) AS t2 FROM fo GROUP BY 1),
    f AS (SELECT family, fold, t0 - o0 AS f0, t1 - o1 AS f1, t2 - o2 AS f2 FROM fo JOIN ft USING (family)),
    j AS (SELECT row_id, fold, CASE WHEN f0 + f1 + f2 > 0 THEN f0 ELSE tr.c0 END AS c0, CASE WHEN f0 + f1 + f2 > 0 THEN f1 ELSE tr.c1 END AS c1, CASE WHEN f0 + f1 + f2 > 0 THEN f2 ELSE tr.c2 END AS c2,
      f0 + f1 + f2 > 0 AS family_seen FROM preds JOIN tr USING (fold) LEFT JOIN f USING (family, fold))
    SELECT row_id, {_MAJ} AS pred, round({_SHARE.format(i=0)}, 6) AS p0, round({_SHARE.format(i=1)}, 6) AS p1, round({_SHARE.format(i=2)}, 6) AS p2, family_seen FROM j""",
)
def b3(spark, sf):
    return _p(R.family_frequency_reference(rows(spark, sf), label="label", family="family", classes=C, strict=False), "row_id", "family_seen")


def draws_sql(src, cluster, n, seed, out="draws", strata="'all'"):
    """The (boot, cluster, weight) table of a with-replacement draw."""
    return f"""{out}_c AS (SELECT DISTINCT {cluster} AS c, {strata} AS st FROM {src}),
    {out}_n AS (SELECT c, st, row_number() OVER (PARTITION BY st ORDER BY {B.hex_sql('unit', 'c')}, c) - 1 AS idx, count(*) OVER (PARTITION BY st) AS sz FROM {out}_c),
    {out}_s AS (SELECT st, sz, idx, unnest(range(0, {n})) AS boot FROM {out}_n),
    {out}_h AS (SELECT boot, st, {B.h_sql(seed, 'boot', 'st', 'idx')} % sz AS idx, count(*) AS w FROM {out}_s GROUP BY ALL),
    {out} AS (SELECT boot, c AS {cluster}, w FROM {out}_h JOIN {out}_n USING (st, idx))"""


def interval_sql(values, n, keys=""):
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    ok = f"count(value) / {n}::DOUBLE >= 0.99"
    return f"""SELECT {k} count(value) AS n_resamples, {n} - count(value) AS n_discarded, CASE WHEN {ok} THEN quantile_cont(value, {(1 - 0.95) / 2!r}) END AS ci_low, CASE WHEN {ok} THEN quantile_cont(value, {(1 + 0.95) / 2!r}) END AS ci_high, NOT ({ok}) AS ci_suppressed FROM {values} {g}"""


@query(
    "b4_floor_interval",
    f"""WITH {P}, {_TRAIN}, q AS (SELECT gene, fold, label, {_MAJ} AS pred FROM preds JOIN tr USING (fold)), {draws_sql('preds', 'gene', 1000, 1)},
    w AS (SELECT boot, fold, label, pred, w FROM q JOIN draws USING (gene)), v AS (SELECT boot, avg(macro_f1) AS value FROM ({class_metrics_sql('w', 'boot, fold', 'w')}) GROUP BY 1),
    p AS (SELECT avg(macro_f1) AS point FROM ({class_metrics_sql('q', 'fold')}))
    SELECT 'macro_f1' AS metric, round(point, 6) AS point, n_resamples, n_discarded, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, ci_suppressed FROM p, ({interval_sql('v', 1000)})""",
)
def b4(spark, sf):
    ref = R.majority_reference(rows(spark, sf), label="label", classes=C)
    out = S.bootstrap_interval(ref, {"macro_f1": S.MacroF1("label", "pred", C, "fold", 5)}, cluster="gene", n_boot=1000, seed=1)
    return rounded(out.drop("discard_frac"), "point", "ci_low", "ci_high")


@query(
    "b5_within_family_reference",
    f"""WITH {P}, {_OWN.format(n='fo', k='family,')}, ft AS (SELECT family, sum(o0) AS t0, sum(o1) AS t1, sum(o2) AS t2 FROM fo GROUP BY 1), f AS (SELECT family, fold, t0 - o0 AS c0, t1 - o1 AS c1, t2 - o2 AS c2 FROM fo JOIN ft USING (family)),
    g AS (SELECT * FROM f WHERE (c0 > c1 AND c0 > c2) OR (c1 > c0 AND c1 > c2) OR (c2 > c0 AND c2 > c1)),
    q AS (SELECT family, fold, label, {_MAJ} AS pred FROM preds JOIN g USING (family, fold)) SELECT family, round(avg(macro_f1), 6) AS mean, round(stddev_pop(macro_f1), 6) AS std, count(macro_f1) AS n FROM ({class_metrics_sql('q', 'family, fold')}) GROUP BY family""",
)
def b5(spark, sf):
    """The majority reference inside each family; (family, fold) cells with a tied training majority are left out."""
    r = rows(spark, sf)
    counts = R.training_counts(r, label="label", classes=C, keys=["family"])
    top = F.greatest("c0", "c1", "c2")
    clear = counts.where(((F.col("c0") == top).cast("int") + (F.col("c1") == top).cast("int") + (F.col("c2") == top).cast("int")) == 1)
    best = F.when(F.col("c0") == top, "F").when(F.col("c1") == top, "O").otherwise("P")
    ref = r.join(clear.select("family", "fold", best.alias("pred")), ["family", "fold"])
    per = M.class_metrics(ref, y="label", pred="pred", classes=C, keys=["family", "fold"])
    return rounded(M.mean_std_n(per, value="macro_f1", keys=["family"]), "mean", "std")
