"""M: model fits over folds. Fits have no SQL twin; closed forms and invariants do."""

from pyspark.sql import functions as F

from kinfold.catalog.metrics import rounded
from kinfold.catalog.registry import query
from kinfold.functions.vector_expr import difference, norm
from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators import reference as R
from kinfold.operators import splits as P
from kinfold.operators.networks import Network
from kinfold.operators.routed_trees import RoutedTrees
from kinfold.plans import bindings as B

THREE = ("c0", "c1", "c2")


def folded(rows, unit="gene", n=3, seed=0):
    return rows.join(P.group_folds(rows, unit, n, seed), unit)


def three_class(spark, sf):
    """Vectors with ten labels merged into three classes."""
    rows = B.vectors(spark, sf).withColumn("cls", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    return folded(rows.drop("label"))


def two_class(spark, sf, unit="gene"):
    return folded(B.vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("int")).drop("label"), unit)


def score(oof, label, classes):
    return M.class_metrics(oof, y=label, pred="pred", classes=classes, keys=["fold"]).join(
        M.macro_auroc(oof, y=label, proba="proba", classes=classes, keys=["fold"]), "fold"
    )


def oof3(spark, sf, estimator, **kw):
    return L.out_of_fold(three_class(spark, sf), estimator, row_id="row_id", vec="vec", label="cls", classes=THREE, keep=["gene"], **kw)


@query("m1_multinomial_logistic")
def m1(spark, sf):
    return score(oof3(spark, sf, L.logistic()), "cls", THREE)


@query("m1_prescaled_logistic")
def m1_prescaled(spark, sf):
    return score(oof3(spark, sf, L.logistic(), scale=False), "cls", THREE)


@query("m2_pca_logistic")
def m2(spark, sf):
    return score(oof3(spark, sf, L.logistic(), reduce_to=16, balance="none"), "cls", THREE)


@query("m3_binary_logistic")
def m3(spark, sf):
    oof = L.out_of_fold(two_class(spark, sf), L.logistic(), row_id="row_id", vec="vec", label="y", classes=(0, 1))
    return M.ranking_metrics(oof.withColumn("p", F.get("proba", F.lit(1))), y="y", score="p", keys=["fold"])


def part_rows(spark, sf):
    """Two features with gaps, three classes; one class is larger in size."""
    a = B.attributes(spark, sf).withColumn("cls", F.concat(F.lit("c"), (F.col("gene") % 3).cast("string")))
    a = a.withColumn("size", F.when(F.col("cls") == "c1", F.col("size") + 20).otherwise(F.col("size")))
    rows = folded(a.withColumnRenamed("gene", "row_id").withColumn("gene", F.col("row_id") % 200))
    return rows.withColumns({"x": L.null_tolerant_vector(["price", "size"]), "gaps": L.nullable_vector(["price", "size"])})


@query("m4_null_tolerant_trees")
def m4(spark, sf):
    """The sentinel form on a forest."""
    oof = L.out_of_fold(part_rows(spark, sf), L.forest(20, 5), row_id="row_id", vec="x", label="cls", classes=THREE, scale=False)
    return score(oof, "cls", THREE)


@query("m4_routed_trees")
def m4_routed(spark, sf):
    """Boosted trees that learn the side of nulls."""
    return score(L.out_of_fold(part_rows(spark, sf), RoutedTrees(), row_id="row_id", vec="gaps", label="cls", classes=THREE), "cls", THREE)


@query("m4_boosted_trees")
def m4_boosted(spark, sf):
    rows = part_rows(spark, sf).withColumn("y", (F.col("cls") == "c1").cast("int"))
    oof = L.out_of_fold(rows, RoutedTrees(), row_id="row_id", vec="gaps", label="y", classes=(0, 1))
    return M.ranking_metrics(oof.withColumn("p", F.get("proba", F.lit(1))), y="y", score="p", keys=["fold"])


def network(spark, sf):
    """Three classes, whole genes held back from training in every fold, one network each."""
    rows = three_class(spark, sf)
    return rows, P.validation_groups(rows, group="gene", fold="fold", n_folds=3, seed=0)


@query("m5_perceptron")
def m5(spark, sf):
    rows, held = network(spark, sf)
    return score(L.out_of_fold(rows, Network(), row_id="row_id", vec="vec", label="cls", classes=THREE, held=held, group="gene"), "cls", THREE)


@query("m5_early_stopping")
def m5_stopping(spark, sf):
    """The held-back loss after every epoch, and the epoch that is kept."""
    rows, held = network(spark, sf)
    return L.fit_folds(rows, Network(), row_id="row_id", vec="vec", label="cls", classes=THREE, held=held, group="gene").fit.history(spark)


@query("m6_forest")
def m6(spark, sf):
    return score(oof3(spark, sf, L.forest(20, 6), scale=False), "cls", THREE)


def one_feature(spark, sf):
    return folded(B.variants(spark, sf), n=5).withColumn("x", F.array((F.col("gene_score") / 1000).cast("double"))).withColumn("t", F.col("score") / 1000)


_ONE = f"{B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'gene', 5, 0, 'folds')}, v AS (SELECT row_id, gene, family, fold, gene_score / 1000 AS x, score / 1000 AS t FROM variants JOIN folds USING (gene))"
_SUMS = "count(*) AS n, sum(x) AS sx, sum(t) AS st, sum(x * x) AS sxx, sum(x * t) AS sxt"


def ridge_sql(key):
    """Ridge with one standardised feature: weight = Sxy / (Sxx + alpha · var)."""
    return f"""o AS (SELECT {key}, {_SUMS} FROM v GROUP BY 1), a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(st) AS st, sum(sxx) AS sxx, sum(sxt) AS sxt FROM o),
    r AS (SELECT {key}, a.n - o.n AS n, a.sx - o.sx AS sx, a.st - o.st AS st, a.sxx - o.sxx AS sxx, a.sxt - o.sxt AS sxt, o.n AS own FROM o, a),
    w AS (SELECT {key}, own, sx / n AS mx, st / n AS mt, (sxt - sx * st / n) / ((sxx - sx * sx / n) * (1 + 1.0 / n)) AS w FROM r)"""


@query("m7_ridge_folds", f"WITH {_ONE}, {ridge_sql('fold')} SELECT row_id, fold, round(mt + w * (x - mx), 5) AS predicted FROM v JOIN w USING (fold)")
def m7(spark, sf):
    p = L.ridge_folds(one_feature(spark, sf), vec="x", target="t", keep=["row_id"])
    return p.select("row_id", "fold", F.round("predicted", 5).alias("predicted"))


@query("m7_ridge_report")
def m7_report(spark, sf):
    rows = folded(B.vectors(spark, sf).withColumn("t", F.get("vec", F.lit(0)) * 3 + F.col("label")))
    return L.regression_report(L.ridge_folds(rows, vec="vec", target="t", keep=["row_id"]), target="t")


@query("m8_leave_group_out_ridge", f"WITH {_ONE}, {ridge_sql('family')} SELECT row_id, family, round(mt + w * (x - mx), 5) AS predicted FROM v JOIN w USING (family) WHERE own >= 5")
def m8(spark, sf):
    p = L.leave_group_out_ridge(one_feature(spark, sf), group="family", vec="x", target="t", keep=["row_id"])
    return p.select("row_id", "family", F.round("predicted", 5).alias("predicted"))


@query("m8_per_group_spearman")
def m8_rho(spark, sf):
    rows = B.vectors(spark, sf).withColumn("t", F.get("vec", F.lit(0)) * 3 + F.get("vec", F.lit(5)))
    return M.spearman(L.leave_group_out_ridge(rows, group="family", vec="vec", target="t"), ["family"], x="predicted", y="t")


@query("m9_nested_alpha")
def m9(spark, sf):
    rows = folded(B.vectors(spark, sf).withColumn("t", F.get("vec", F.lit(0)) * 3 + F.col("label")))
    return L.choose_alpha(rows, vec="vec", target="t")


@query("m10_pls_sweep")
def m10(spark, sf):
    rows = folded(B.vectors(spark, sf).withColumn("t", F.get("vec", F.lit(0)) * 3 + F.get("vec", F.lit(5))))
    return M.spearman(L.pls_sweep(rows, vec="vec", target="t", components=(1, 2, 5, 10)), ["n_components", "fold"], x="predicted", y="t")


@query("m11_tree_regression")
def m11(spark, sf):
    rows = folded(B.vectors(spark, sf).withColumn("t", F.get("vec", F.lit(0)) * 3 + F.col("label")), n=2)
    out = [M.spearman(L.tree_regression(rows, vec="vec", target="t", row_id="row_id", kind=k), ["fold"], x="predicted", y="t").withColumn("arm", F.lit(k)) for k in ("forest", "boosted")]
    return out[0].unionByName(out[1])


@query("m12_cascade")
def m12(spark, sf):
    rows = folded(B.vectors(spark, sf).withColumn("cls", F.element_at(F.array(F.lit("GOF"), F.lit("DN"), F.lit("LOF"), F.lit("LOF")), (1 + F.col("label") % 4).cast("int"))), "family", 2)
    arms = [L.cascade(rows, row_id="row_id", vec="vec", label="cls", family="family", classes=("GOF", "DN", "LOF"), arm=a, n_clusters=4) for a in ("unbalanced", "family_matched", "size_matched")]
    both = arms[0].unionByName(arms[1]).unionByName(arms[2])
    return M.class_metrics(both, y="cls", pred="pred", classes=("GOF", "DN", "LOF"), keys=["arm", "fold"])


@query("m13_permutation_importance")
def m13(spark, sf):
    rows = two_class(spark, sf)
    model = L.fit_whole(rows, RoutedTrees(), vec="vec", label="y", classes=(0, 1))
    return L.permutation_importance(rows, model, row_id="row_id", vec="vec", names=[f"x{i}" for i in range(64)], label="y", classes=(0, 1))


@query("m14_family_probe")
def m14(spark, sf):
    rows = B.vectors(spark, sf).drop("label")
    classes = tuple(r[0] for r in rows.groupBy("family").agg(F.count("*").alias("n")).where("n >= 3").orderBy("family").select("family").collect())
    kept = rows.where(F.col("family").isin(*classes))
    split = P.stratified_folds(kept, row_id="row_id", stratum="family", n_folds=3, seed=0)
    oof = L.out_of_fold(split, L.logistic(), row_id="row_id", vec="vec", label="family", classes=classes)
    accuracy = oof.groupBy("fold").agg(F.avg((F.col("pred") == F.col("family")).cast("double")).alias("accuracy"))
    base = R.training_counts(split, label="family", classes=classes)
    share = F.greatest(*[F.col(f"c{i}") for i in range(len(classes))]) / sum([F.col(f"c{i}") for i in range(1, len(classes))], F.col("c0"))
    return accuracy.join(base.select("fold", share.alias("majority_share")), "fold")


@query(
    "m15_align_proba",
    f"WITH {B.predictions_sql()} SELECT row_id, round(proba[3], 6) AS p_p, round(proba[1], 6) AS p_f, 0.0::DOUBLE AS p_x FROM preds",
)
def m15(spark, sf):
    p = L.align_proba(B.predictions(spark, sf), proba="proba", given=["F", "O", "P"], declared=["P", "O", "F", "X"])
    return p.select("row_id", F.round(F.get("proba", F.lit(0)), 6).alias("p_p"), F.round(F.get("proba", F.lit(2)), 6).alias("p_f"), F.get("proba", F.lit(3)).alias("p_x"))


@query("m16_oof_coverage", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated FROM embeddings")
def m16(spark, sf):
    return L.oof_coverage(oof3(spark, sf, L.logistic()), B.vectors(spark, sf), row_id="row_id")


@query(
    "m16_oof_table",
    f"WITH {B.VECTORS_SQL}, {B.group_folds_sql('vectors', 'gene', 3, 0, 'folds')} SELECT row_id, gene, fold, 'c' || label % 3 AS cls, 1.0::DOUBLE AS total FROM vectors JOIN folds USING (gene)",
)
def m16_table(spark, sf):
    total = F.aggregate("proba", F.lit(0.0), lambda a, p: a + p)
    return oof3(spark, sf, L.logistic()).select("row_id", "gene", "fold", "cls", F.round(total, 6).alias("total"))


def axis_rows(spark, sf):
    p = B.pairs(spark, sf).select("row_id", "gene", "family", difference("mut", "wt").alias("vec"), (F.col("label") < 5).cast("int").alias("y"), F.get("mut", F.lit(0)).alias("f0"), F.get("wt", F.lit(1)).alias("f1"))
    return folded(p.withColumn("f2", norm("vec")))


@query("m17_axis_associations")
def m17(spark, sf):
    s = L.axis_scores(axis_rows(spark, sf), row_id="row_id", vec="vec", label="y", classes=(0, 1), keep=["f0", "f1", "f2"])
    return L.axis_associations(s, features=["f0", "f1", "f2"])


@query("m17_axis_regression")
def m17_r2(spark, sf):
    s = L.axis_scores(axis_rows(spark, sf), row_id="row_id", vec="vec", label="y", classes=(0, 1), keep=["f0", "f1", "f2"])
    return L.axis_regression(s, features=["f0", "f1", "f2"])


@query("m18_pair_directions")
def m18(spark, sf):
    import numpy as np

    return L.direction_cosines(three_class(spark, sf), vec="vec", label="cls", classes=THREE, reference=np.ones(64), row_id="row_id")
