"""M and V fits on inputs whose answer SQL can say: one or two features in closed form, and planted classes."""

from pyspark.sql import functions as F

from kinfold.catalog.metrics import ranking_sql, rounded, spearman_sql
from kinfold.catalog.models import _ONE, THREE, folded, one_feature, ridge_sql
from kinfold.catalog.registry import query
from kinfold.functions.vector_expr import difference
from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators import splits as P
from kinfold.operators import vectors as V
from kinfold.operators.networks import Network
from kinfold.operators.routed_trees import RoutedTrees
from kinfold.plans import bindings as B

# --- one and two features -------------------------------------------------------

_RIDGE = f"{_ONE}, {ridge_sql('fold')}, p AS (SELECT fold, t, mt + w * (x - mx) AS predicted FROM v JOIN w USING (fold))"


@query(
    "m7_report_one_feature",
    f"""WITH {_RIDGE}, m AS (SELECT fold, quantile_cont(t, 0.5) AS med FROM p GROUP BY 1), b AS (SELECT fold, CASE WHEN t >= med THEN 1 ELSE 0 END AS y, predicted AS s0 FROM p JOIN m USING (fold)),
    rk AS ({spearman_sql('p', 'fold', 'predicted', 't')}), c AS (SELECT fold, corr(predicted, t) AS pearson FROM p GROUP BY 1), au AS ({ranking_sql('b', 'fold', score='s0')})
    SELECT fold, n, round(rho, 6) AS rho, round(pearson, 6) AS pearson, round(auroc, 6) AS auroc FROM rk JOIN c USING (fold) JOIN au USING (fold)""",
)
def m7_report(spark, sf):
    return rounded(L.regression_report(L.ridge_folds(one_feature(spark, sf), vec="x", target="t", keep=["row_id"]), target="t").select("fold", "n", "rho", "pearson", "auroc"), "rho", "pearson", "auroc")


_RIDGE_OUT = f"{_ONE}, {ridge_sql('family')}, p AS (SELECT family, t, mt + w * (x - mx) AS predicted FROM v JOIN w USING (family) WHERE own >= 5)"


@query("m8_spearman_one_feature", f"WITH {_RIDGE_OUT} SELECT family, n, round(rho, 6) AS rho FROM ({spearman_sql('p', 'family', 'predicted', 't')})")
def m8_rho(spark, sf):
    p = L.leave_group_out_ridge(one_feature(spark, sf), group="family", vec="x", target="t")
    return rounded(M.spearman(p, ["family"], x="predicted", y="t").select("family", "n", "rho"), "rho")


@query(
    "m9_penalty_one_feature",
    f"""WITH {_ONE}, o AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(t) AS st, sum(x * x) AS sxx, sum(x * t) AS sxt FROM v GROUP BY 1),
    a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(st) AS st, sum(sxx) AS sxx, sum(sxt) AS sxt FROM o),
    s AS (SELECT o.fold, a.n - o.n AS n, (a.sx - o.sx) / (a.n - o.n) AS mx, (a.st - o.st) / (a.n - o.n) AS mt, a.sxx - o.sxx AS sxx, a.sxt - o.sxt AS sxt FROM o, a),
    d AS (SELECT fold, n, mx, mt, sqrt(sxx / n - mx * mx) AS sd, sxt - n * mx * mt AS c FROM s), g AS (SELECT unnest([0.1, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS alpha),
    e AS (SELECT d.fold, alpha, sum(pow((t - mt - (x - mx) / sd * (c / sd) / (n + alpha)) / (1 - 1.0 / n - pow((x - mx) / sd, 2) / (n + alpha)), 2)) AS error
      FROM d, g, v WHERE v.fold <> d.fold GROUP BY 1, 2)
    SELECT fold, alpha, round(error / 1000, 3) AS error, row_number() OVER (PARTITION BY fold ORDER BY error, alpha) = 1 AS chosen FROM e""",
)
def m9(spark, sf):
    return L.choose_alpha(one_feature(spark, sf), vec="x", target="t").withColumn("error", F.round(F.col("error") / 1000, 3))


_TWO = f"{_ONE}, u AS (SELECT row_id, fold, x, CAST(row_id % 97 AS DOUBLE) AS z, t FROM v)"


@query(
    "m10_pls_two_features",
    f"""WITH {_TWO}, o AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(t) AS st, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * t) AS xt, sum(z * t) AS zt FROM u GROUP BY 1),
    a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sz) AS sz, sum(st) AS st, sum(xx) AS xx, sum(zz) AS zz, sum(xz) AS xz, sum(xt) AS xt, sum(zt) AS zt FROM o),
    s AS (SELECT o.fold, a.n - o.n AS n, a.sx - o.sx AS sx, a.sz - o.sz AS sz, a.st - o.st AS st, a.xx - o.xx AS xx, a.zz - o.zz AS zz, a.xz - o.xz AS xz, a.xt - o.xt AS xt, a.zt - o.zt AS zt FROM o, a),
    c AS (SELECT fold, n, sx / n AS mx, sz / n AS mz, st / n AS mt, sqrt((xx - sx * sx / n) / (n - 1)) AS dx, sqrt((zz - sz * sz / n) / (n - 1)) AS dz, xz - sx * sz / n AS cxz, xt - sx * st / n AS cxt, zt - sz * st / n AS czt FROM s),
    k AS (SELECT *, cxt / dx AS bx, czt / dz AS bz, cxz / (dx * dz) AS r FROM c),
    w AS (SELECT fold, 1 AS n_components, mx, mz, mt, bx * q / dx AS wx, bz * q / dz AS wz FROM (SELECT *, (bx * bx + bz * bz) / ((n - 1) * (bx * bx + bz * bz) + 2 * r * bx * bz) AS q FROM k)
      UNION ALL SELECT fold, 2, mx, mz, mt, ((n - 1) * bx - r * bz) / ((n - 1.0) * (n - 1) - r * r) / dx, ((n - 1) * bz - r * bx) / ((n - 1.0) * (n - 1) - r * r) / dz FROM k)
    SELECT row_id, fold, CAST(n_components AS INTEGER) AS n_components, round(mt + wx * (x - mx) + wz * (z - mz), 4) AS predicted FROM u JOIN w USING (fold)""",
)
def m10(spark, sf):
    rows = one_feature(spark, sf).withColumn("x", F.array(F.get("x", F.lit(0)), (F.col("row_id") % 97).cast("double")))
    p = L.pls_sweep(rows, vec="x", target="t", components=(1, 2), keep=["row_id"])
    return p.select("row_id", "fold", "n_components", F.round("predicted", 4).alias("predicted"))


_SIDE = f"{B.VECTORS_SQL}, {B.group_folds_sql('vectors', 'gene', 3, 0, 'folds')}, v AS (SELECT row_id, fold, vec[1] AS x, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM vectors JOIN folds USING (gene))"


@query(
    "m3_logistic_one_feature",
    f"""WITH {_SIDE}, d AS (SELECT f.fold, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) AS way FROM (SELECT DISTINCT fold FROM v) f JOIN v ON v.fold <> f.fold GROUP BY 1),
    s AS (SELECT fold, y, sign(way) * x AS s0 FROM v JOIN d USING (fold)) SELECT fold, n_pos, n_neg, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM ({ranking_sql('s', 'fold', score='s0')})""",
)
def m3(spark, sf):
    """With one feature the fit ranks by it, in the direction of the class means."""
    rows = folded(B.vectors(spark, sf).select("row_id", "gene", F.slice("vec", 1, 1).alias("vec"), (F.col("label") < 5).cast("int").alias("y")))
    oof = L.out_of_fold(rows, L.logistic(), row_id="row_id", vec="vec", label="y", classes=(0, 1))
    got = M.ranking_metrics(oof.withColumn("p", F.get("proba", F.lit(1))), y="y", score="p", keys=["fold"])
    return rounded(got.select("fold", "n_pos", "n_neg", "auroc", "average_precision"), "auroc", "average_precision")


def _shares_sql(values: str, keys: str) -> str:
    """Variance shares of the two axes of a 2x2 covariance."""
    return f"""SELECT {keys}, 0.5 + sqrt(pow(a - b, 2) / 4 + c * c) / (a + b) AS s1, 0.5 - sqrt(pow(a - b, 2) / 4 + c * c) / (a + b) AS s2 FROM (SELECT {keys}, var_pop(p) AS a, var_pop(q) AS b, covar_pop(p, q) AS c FROM {values} GROUP BY {keys})"""


@query(
    "v5_shares_two_dims",
    f"""WITH {B.VECTORS_SQL}, {B.group_folds_sql('vectors', 'gene', 3, 0, 'folds')}, v AS (SELECT fold, vec[1] AS p, vec[2] AS q FROM vectors JOIN folds USING (gene)),
    t AS (SELECT f.fold, p, q FROM (SELECT DISTINCT fold FROM v) f JOIN v ON v.fold <> f.fold), s AS ({_shares_sql('t', 'fold')})
    SELECT fold, CAST(0 AS INTEGER) AS component, round(s1, 6) AS share FROM s UNION ALL SELECT fold, 1, round(s2, 6) FROM s""",
)
def v5(spark, sf):
    rows = B.vectors(spark, sf)
    two = rows.join(B.group_folds(rows, "gene", 3, 0), "gene").withColumn("vec", F.slice("vec", 1, 2))
    return rounded(L.fold_pca(two, vec="vec", k=2).shares, "share")


@query(
    "v14_shares_two_dims",
    f"WITH {B.PAIRS_SQL}, v AS (SELECT family, mut[1] - wt[1] AS p, mut[2] - wt[2] AS q FROM pairs) SELECT family, round(s1, 6) AS pc1_share, round(s2, 6) AS pc2_share FROM ({_shares_sql('v', 'family')})",
)
def v14(spark, sf):
    rows = B.pairs(spark, sf).select("family", F.slice(difference("mut", "wt"), 1, 2).alias("d"))
    return rounded(V.principal_shares(rows, group="family", vec="d").select("family", "pc1_share", "pc2_share"), "pc1_share", "pc2_share")


@query(
    "v15_axes_two_dims",
    f"""WITH {B.PAIRS_SQL}, a AS (SELECT family, mut[1] - wt[1] AS p, mut[2] - wt[2] AS q FROM pairs), v AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY family) >= 4)
    SELECT family, round(s1, 6) AS pc1_share, round(s1 / (s2 + 1e-8), 5) AS pc1_pc2_ratio FROM ({_shares_sql('v', 'family')})""",
)
def v15_axes(spark, sf):
    rows = B.pairs(spark, sf).select("family", F.slice(difference("mut", "wt"), 1, 2).alias("d"), F.lit(1).alias("pos"), F.lit(9).alias("length"))
    f = V.scan_features(rows, group="family", delta="d", pos="pos", seq_len="length", min_rows=4)
    return f.select("family", F.round("pc1_share", 6).alias("pc1_share"), F.round("pc1_pc2_ratio", 5).alias("pc1_pc2_ratio"))


# --- planted classes --------------------------------------------------------------


def planted(spark, sf):
    """A vector that says the class (one of three, four units apart) and one real dimension beside it."""
    rows = B.vectors(spark, sf).withColumn("cls", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    says = [F.when(F.col("label") % 3 == i, 4.0).otherwise(0.0) for i in range(3)]
    return folded(rows.withColumn("vec", F.array(*says, F.get("vec", F.lit(0)))))


def right(oof, label):
    """(fold, n, n_right, n_whole): rows, rows whose class is recovered, rows whose shares sum to one."""
    whole = F.abs(F.aggregate("proba", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9
    return oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col(label)).alias("n_right"), F.count_if(whole).alias("n_whole"))


_ALL = f"WITH {B.VECTORS_SQL}, {B.group_folds_sql('vectors', 'gene', 3, 0, 'folds')} SELECT fold, count(*) AS n, count(*) AS n_right, count(*) AS n_whole FROM vectors JOIN folds USING (gene) GROUP BY fold"
LEARNERS = {
    "m1_planted_classes": (lambda: L.logistic(), {}),
    "m2_planted_classes": (lambda: L.logistic(), {"reduce_to": 3, "balance": "none"}),
    "m4_planted_forest": (lambda: L.forest(20, 5), {"scale": False}),
    "m4_planted_boosted": (lambda: L.boosted(5, 3), {"scale": False}),
    "m5_planted_perceptron": (lambda: L.perceptron((16,), 100), {"balance": "oversample"}),
    "m6_planted_forest": (lambda: L.forest(), {"scale": False}),
}


def _planted(name):
    make, options = LEARNERS[name]

    @query(name, _ALL)
    def run(spark, sf):
        return right(L.out_of_fold(planted(spark, sf), make(), row_id="row_id", vec="vec", label="cls", classes=THREE, **options), "cls")


for _name in LEARNERS:
    _planted(_name)


@query(
    "m4_planted_nulls",
    f"""WITH {B.ATTRIBUTES_SQL}, {B.group_folds_sql('attributes', 'gene', 3, 0, 'folds')}
    SELECT fold, count(*) AS n, count(*) AS n_right, count(*) AS n_whole FROM attributes JOIN folds USING (gene) GROUP BY fold""",
)
def m4_nulls(spark, sf):
    """Nulls of size belong with large sizes for even ids and with small sizes for odd ones; every row is told."""
    a = B.attributes(spark, sf).withColumn("y", F.when(F.col("size").isNull(), F.col("gene") % 2 == 0).otherwise(F.col("size") > 25).cast("int"))
    rows = folded(a.withColumns({"row_id": F.col("gene"), "vec": F.array((F.col("gene") % 2).cast("double"), "size")}))
    return right(L.out_of_fold(rows, RoutedTrees(10, 3, rate=0.5, min_rows=5), row_id="row_id", vec="vec", label="y", classes=(0, 1)), "y")


@query("m5_planted_network", _ALL)
def m5_network(spark, sf):
    rows = planted(spark, sf)
    held = P.validation_groups(rows, group="gene", fold="fold", n_folds=3, seed=0)
    spec = Network((16,), rate=0.02, dropout=0.0, max_epochs=30, patience=5)
    return right(L.out_of_fold(rows, spec, row_id="row_id", vec="vec", label="cls", classes=THREE, held=held, group="gene"), "cls")


@query(
    "m5_held_back_groups",
    f"""WITH {B.VECTORS_SQL}, {B.group_folds_sql('vectors', 'gene', 3, 0, 'folds')}, t AS (SELECT f.fold, g.gene FROM (SELECT DISTINCT fold FROM folds) f JOIN folds g ON f.fold <> g.fold),
    r AS (SELECT fold, gene, row_number() OVER (PARTITION BY fold ORDER BY {B.hex_sql(0, 'fold', 'gene')}, gene) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n FROM t)
    SELECT fold, count(*) AS n_held FROM r WHERE k < least(greatest(1, floor(n * CAST(0.15 AS DOUBLE))), n - 1) GROUP BY fold""",
)
def m5_held(spark, sf):
    return P.validation_groups(planted(spark, sf), group="gene", fold="fold", n_folds=3, seed=0).groupBy("fold").agg(F.count(F.lit(1)).alias("n_held"))


@query(
    "m11_planted_forest",
    f"WITH {B.VECTORS_SQL}, {B.group_folds_sql('vectors', 'gene', 3, 0, 'folds')} SELECT row_id, fold, label * label * 1.0::DOUBLE AS t, label * label * 1.0::DOUBLE AS predicted FROM vectors JOIN folds USING (gene)",
)
def m11(spark, sf):
    """A target that one column decides is met exactly."""
    rows = folded(B.vectors(spark, sf).withColumn("t", (F.col("label") * F.col("label")).cast("double")).withColumn("vec", F.array(F.col("label").cast("double"))))
    return rounded(L.tree_regression(rows, vec="vec", target="t", row_id="row_id"), "t", "predicted")


@query(
    "m14_planted_families",
    f"""WITH {B.VECTORS_SQL}, r AS (SELECT row_id, family, CAST((row_number() OVER (PARTITION BY family ORDER BY {B.hex_sql(0, 'row_id')}, row_id) - 1) % 3 AS INTEGER) AS fold, count(*) OVER (PARTITION BY family) AS m FROM vectors)
    SELECT fold, count(*) AS n, count(*) AS n_right, count(*) AS n_whole FROM r WHERE m >= 3 GROUP BY fold""",
)
def m14(spark, sf):
    rows = B.vectors(spark, sf).select("row_id", "family", F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.when(i == F.col("family"), 1.0).otherwise(0.0)).alias("vec"))
    split = P.stratified_folds(rows, row_id="row_id", stratum="family", n_folds=3, seed=0)
    return right(L.out_of_fold(split, L.logistic(), row_id="row_id", vec="vec", label="family", classes=tuple(range(17))), "family")
