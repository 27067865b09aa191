"""D: composed studies."""

from pyspark.sql import functions as F

from kinfold.catalog.metrics import class_metrics_sql, ranking_sql, rounded
from kinfold.catalog.registry import query
from kinfold.functions.notation import LETTERS
from kinfold.functions.rows import attach_row
from kinfold.functions.vector_expr import norm
from kinfold.operators import groups as G
from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators import sequence as Q
from kinfold.operators import splits as P
from kinfold.operators import vectors as V
from kinfold.operators.routed_trees import RoutedTrees
from kinfold.plans import bindings as B
from kinfold.plans import studies as D
from kinfold.sources.documents import flatten_json

T = B.table
C = B.CLASSES
THREE = ("c0", "c1", "c2")


def pair_rows(spark, sf):
    """Paired vectors with a binary label and the derived arms."""
    p = V.paired_features(B.pairs(spark, sf), wt="wt", mut="mut")
    return p.withColumn("y", (F.col("label") < 5).cast("int"))


def three(rows):
    return rows.withColumn("cls", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))


@query("d1_split_gap")
def d1(spark, sf):
    grid = D.score_grid(
        three(pair_rows(spark, sf)), {"wt": "wt", "delta": "delta"}, {"group": "gene", "family": "family"}, row_id="row_id", label="cls", classes=THREE, seeds=range(5), n_folds=5,
    )
    return D.split_gap(grid, seeds=range(5), n_folds=5)


SEEDS = (0, 1, 2)


def _leak_sql(unit, name, seed, tag):
    """Predictions of one arm and seed, as a common table."""
    f = B.group_folds_sql("variants", unit, 5, seed, f"fo{name}")
    return f"{f}, jo{name} AS (SELECT * FROM lv JOIN fo{name} USING ({unit})), {B.shares_sql(f'jo{name}', tag, f'p{name}')}, q{name} AS (SELECT *, {B.PRED_SQL} AS pred FROM p{name})"


def _leak_scores_sql(unit):
    parts, rows = [], []
    for s in SEEDS:
        parts += [_leak_sql("gene", f"g{s}", s, f"g{s}"), _leak_sql(unit, f"f{s}", s, f"f{s}")]
        own = f"own{s} AS (SELECT fold, count(*) FILTER (label = 'F') AS o0, count(*) FILTER (label = 'O') AS o1, count(*) FILTER (label = 'P') AS o2 FROM qg{s} GROUP BY 1)"
        maj = f"SELECT fold, (SELECT sum(o0) FROM own{s}) - o0 AS c0, (SELECT sum(o1) FROM own{s}) - o1 AS c1, (SELECT sum(o2) FROM own{s}) - o2 AS c2 FROM own{s}"
        parts += [own, f"ch{s} AS (SELECT fold, label, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'F' WHEN c1 >= c2 THEN 'O' ELSE 'P' END AS pred FROM qg{s} JOIN ({maj}) USING (fold))"]
        mean = lambda src: f"(SELECT avg(macro_f1) FROM ({class_metrics_sql(src, 'fold')}))"
        rows.append(f"SELECT {s} AS seed, {mean(f'qg{s}')} AS g, {mean(f'qf{s}')} AS f, {mean(f'ch{s}')} AS c")
    return f"WITH {B.VARIANTS_SQL}, lv AS (SELECT * REPLACE (CASE WHEN row_id % 4 = 0 THEN 'F' ELSE label END AS label) FROM variants), {', '.join(parts)}, sc AS ({' UNION ALL '.join(rows)})"


def leak_arms(spark, sf, unit="family"):
    """Predictions of three seeds under a group split and under a coarser split; one class is the clear majority at every size."""
    rows = B.variants(spark, sf).withColumn("label", F.when(F.col("row_id") % 4 == 0, "F").otherwise(F.col("label")))

    def arm(by, tag):
        out = None
        for s in SEEDS:
            p = M.predicted(B.with_shares(rows.join(P.group_folds(rows, by, 5, s), by), f"{tag}{s}"), proba="proba", classes=C).withColumn("seed", F.lit(s))
            out = p if out is None else out.unionByName(p)
        return out.select("row_id", "gene", "family", "source", "label", "fold", "pred", "seed")

    return arm("gene", "g"), arm(unit, "f")


_LEAK = "SELECT CASE WHEN count(v) = 3 THEN 'available' ELSE 'unavailable' END AS state, CASE WHEN count(v) < 3 THEN 'invalid_value' END AS reason, round(CASE WHEN count(v) = 3 THEN avg(v) END, 5) AS leakage, round(CASE WHEN count(v) = 3 THEN stddev_samp(v) END, 5) AS leakage_spread"


@query("d2_leakage_fraction", f"{_leak_scores_sql('family')} {_LEAK} FROM (SELECT CASE WHEN g - c > 0.02 THEN (g - f) / (g - c) END AS v FROM sc)")
def d2(spark, sf):
    a, b = leak_arms(spark, sf)
    s = D.leakage_scores(a, b, row_id="row_id", label="label", classes=C)
    out = D.leakage_fraction(s, seeds=SEEDS)
    return out.withColumns({c: F.round(c, 5) + 0.0 for c in ("leakage", "leakage_spread")})


@query(
    "d3_partition_panel",
    f"""WITH fam AS ({_leak_scores_sql('family')} {_LEAK}, 'family' AS partition, (SELECT count(*) FROM variants) AS n FROM (SELECT CASE WHEN g - c > 0.02 THEN (g - f) / (g - c) END AS v FROM sc)),
    src AS ({_leak_scores_sql('source')} {_LEAK}, 'source' AS partition, (SELECT count(*) FILTER (source <> 'BUILDING') FROM variants) AS n FROM (SELECT CASE WHEN g - c > 0.02 THEN (g - f) / (g - c) END AS v FROM sc)),
    p AS (SELECT * FROM fam UNION ALL SELECT * FROM src) SELECT count(*) AS n_partitions, round(avg(leakage), 4) AS plain_mean, round(sum(leakage * n) / sum(n), 4) AS weighted_mean FROM p WHERE leakage IS NOT NULL""",
)
def d3(spark, sf):
    parts = None
    for unit in ("family", "source"):
        a, b = leak_arms(spark, sf, unit)
        one = D.leakage_fraction(D.leakage_scores(a, b, row_id="row_id", label="label", classes=C), seeds=SEEDS)
        n = B.variants(spark, sf).agg(F.count_if(F.lit(unit == "family") | (F.col("source") != "BUILDING")).alias("n"))
        one = attach_row(one.withColumn("leakage", F.round("leakage", 5)), n)
        parts = one if parts is None else parts.unionByName(one)
    return D.panel_means(parts, value="leakage", weight="n").withColumns({c: F.round(c, 4) + 0.0 for c in ("plain_mean", "weighted_mean")})


@query("d4_within_family")
def d4(spark, sf):
    rows = B.vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("int")).withColumn("fam", F.pmod("gene", F.lit(4)))
    return D.within_family_study(rows, row_id="row_id", vec="vec", y="y", family="fam", gene="gene")


@query("d4_pooled_within_family")
def d4_pooled(spark, sf):
    rows = B.vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("int")).withColumn("fam", F.pmod("gene", F.lit(4)))
    _, scored = D.within_family_scores(rows, row_id="row_id", vec="vec", y="y", family="fam", gene="gene")
    return D.pooled_within_family(scored, family="fam", gene="gene", fold="fold", y="y", score="score", n_folds=3)


@query(
    "d4_pooled_point",
    f"""WITH {B.VECTORS_SQL}, b AS (SELECT gene % 4 AS fam, gene, CAST(gene % 4 * 3 + (gene // 4) % 3 AS INTEGER) AS block, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, vec[1] AS s0 FROM vectors),
    r AS ({ranking_sql('b', 'block', score='s0')}), c AS (SELECT count(DISTINCT fam) AS n_families, count(*) AS n_rows, count(DISTINCT gene) AS n_genes, sum(y) AS n_positive FROM b)
    SELECT n_families, n_rows, n_genes, CAST(n_positive AS BIGINT) AS n_positive, round(point, 6) AS point FROM c, (SELECT avg(auroc) AS point FROM r)""",
)
def d4_point(spark, sf):
    rows = B.vectors(spark, sf).select(
        F.pmod("gene", F.lit(4)).alias("fam"), "gene", F.pmod(F.floor(F.col("gene") / 4), F.lit(3)).cast("int").alias("fold"), (F.col("label") < 5).cast("int").alias("y"), F.get("vec", F.lit(0)).alias("score")
    )
    pooled = D.pooled_within_family(rows, family="fam", gene="gene", fold="fold", y="y", score="score", n_folds=3)
    return pooled.select("n_families", "n_rows", "n_genes", "n_positive", F.round("point", 6).alias("point"))


@query("d5_binary_control")
def d5(spark, sf):
    from kinfold.operators.cleaning import cap_and_balance

    rows = pair_rows(spark, sf)
    kept = cap_and_balance(rows.select("row_id", "family", "y"), group="family", label="y", row_id="row_id", cap=500, seed=0)
    balanced = rows.join(kept.select("row_id"), "row_id", "left_semi")
    return D.score_grid(
        balanced, {"delta": "delta", "wt": "wt", "delta_net": "delta"}, {"group": "gene", "family": "family"}, row_id="row_id", label="y", classes=(0, 1), n_folds=5,
        options={"delta_net": {"estimator": L.perceptron((8,)), "balance": "oversample"}},
    )


@query("d6_magnitude_direction")
def d6(spark, sf):
    arms = D.magnitude_direction_arms(pair_rows(spark, sf), vec="delta")
    return D.score_grid(
        arms, {"full": "full", "magnitude": "magnitude_only", "direction": "direction_only"}, {"family": "family"}, row_id="row_id", label="y", classes=(0, 1), n_folds=5
    )


@query(
    "d6_magnitude_correlation",
    f"""WITH {B.PAIRS_SQL}, d AS (SELECT [mut[i] - wt[i] FOR i IN range(1, 65)] AS d, label - 4.5 AS t FROM pairs), m AS (SELECT sqrt(list_dot_product(d, d)) AS m, abs(t) AS t FROM d),
    r AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS b FROM m) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""",
)
def d6_rho(spark, sf):
    rows = pair_rows(spark, sf).select(norm("delta").alias("m"), F.abs(F.col("label") - 4.5).alias("t"))
    return rounded(M.spearman(rows, [], x="m", y="t"), "rho")


@query("d7_direction_ablation")
def d7(spark, sf):
    rows = pair_rows(spark, sf)
    return D.direction_ablation(rows.join(P.group_folds(rows, "family", 5, 0), "family"), row_id="row_id", vec="delta", label="y", k_max=2)


@query("d7_half_transfer")
def d7_half(spark, sf):
    return D.half_transfer(pair_rows(spark, sf), row_id="row_id", vec="delta", label="y", group="gene", n_partitions=2)


def biochem_rows(spark, sf):
    rows = pair_rows(spark, sf).withColumns(
        {
            "aa_wt": F.substring(F.lit(LETTERS), (1 + F.col("row_id") % 20).cast("int"), F.lit(1)),
            "aa_mut": F.substring(F.lit(LETTERS), (1 + (F.col("row_id") * 7 + 3) % 20).cast("int"), F.lit(1)),
        }
    )
    letters = T(spark, sf, "lineitem").select(
        F.substring(F.lit(LETTERS), (1 + F.col("l_partkey") % 20).cast("int"), F.lit(1)).alias("wt"), F.substring(F.lit(LETTERS), (1 + F.col("l_suppkey") % 20).cast("int"), F.lit(1)).alias("mut")
    )
    scores = letters.groupBy("wt", "mut").agg((F.count("*") % 9 - 4).cast("double").alias("score"))
    out = Q.biochemistry(rows.withColumnsRenamed({"wt": "wt_vec", "mut": "mut_vec"}), scores, wt="aa_wt", mut="aa_mut")
    return out.join(P.group_folds(out, "family", 5, 0), "family")


_BIO = ["hydropathy_change", "hydropathy_distance", "charge_change", "charge_distance", "volume_distance"]


@query("d8_axis_identity")
def d8(spark, sf):
    rows = biochem_rows(spark, sf)
    s = L.axis_scores(rows, row_id="row_id", vec="delta", label="y", classes=(0, 1), keep=_BIO)
    r2 = L.axis_regression(s, features=_BIO).agg(F.avg("r2").alias("rho"), F.count("r2").alias("n_folds")).withColumn("feature", F.lit("r2_of_axis"))
    only = L.out_of_fold(rows.withColumn("x", F.array(*_BIO)), L.logistic(), row_id="row_id", vec="x", label="y", classes=(0, 1))
    auc = M.ranking_metrics(only.withColumn("p", F.get("proba", F.lit(1))), y="y", score="p", keys=["fold"])
    auc = auc.agg(F.avg("auroc").alias("rho"), F.count("auroc").alias("n_folds")).withColumn("feature", F.lit("auroc_biochemistry_only"))
    return L.axis_associations(s, features=_BIO).unionByName(r2).unionByName(auc).withColumnRenamed("rho", "value")


@query("d9_conservation_contrast")
def d9(spark, sf):
    """Conservation against vectors, against both, and the pair of them against vectors."""
    raw = F.transform(F.slice("wt", 1, 20), lambda x: F.abs(x))
    rows = pair_rows(spark, sf).withColumn("r", raw)
    rows = rows.withColumn("t", F.aggregate("r", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("r", lambda x: x / F.col("t")))
    rows = rows.withColumns({"wi": (F.col("row_id") % 20).cast("int"), "mi": (F.col("row_id") % 7).cast("int")})
    f = V.conservation_features(rows, keys=["row_id", "gene", "family", "y", "delta"], probs="p", wt_index="wi", mut_index="mi")
    f = f.withColumn("cons", F.array("logp_wt", "logp_mut", "entropy", "masked_marginal")).withColumn("mm", F.array("masked_marginal"))
    f = f.withColumn("joint", F.concat("cons", "delta"))
    folded = f.join(P.group_folds(f, "family", 5, 0), "family")
    out = None
    for a, b in (("joint", "delta"), ("joint", "cons"), ("cons", "mm")):
        d = D.paired_arm_contrast(folded, a, b, row_id="row_id", label="y", group="gene", n_folds=5).withColumn("contrast", F.lit(f"{a} - {b}"))
        out = d if out is None else out.unionByName(d)
    return out


def stability_rows(spark, sf):
    return pair_rows(spark, sf).withColumn("t", F.get("delta", F.lit(0)) * 3 + F.get("delta", F.lit(7)) + F.col("label") / 20)


@query("d10_stability_study")
def d10(spark, sf):
    return D.stability_study(stability_rows(spark, sf), row_id="row_id", vec="delta", target="t", domain="gene", family="family", n_folds=5)


@query("d10_direction_removal")
def d10_removal(spark, sf):
    task = pair_rows(spark, sf)
    return D.direction_removal_effect(
        stability_rows(spark, sf), task.join(P.group_folds(task, "gene", 5, 0), "gene"), vec="delta", target="t", row_id="row_id", label="y", group="gene", n_folds=5
    )


@query("d11_feature_blocks")
def d11(spark, sf):
    """Vectors, group features, and both under one split; a null group feature goes through the trees."""
    rows = three(pair_rows(spark, sf))
    feats = rows.groupBy("gene").agg(F.avg(norm("delta")).alias("mag"), F.count("*").cast("double").alias("size"))
    feats = feats.select("gene", F.when(F.col("gene") % 5 != 0, F.col("mag")).alias("mag"), "size")
    rows = G.attach_group_features(rows, feats, key="gene", columns=["mag", "size"]).withColumn("block", L.nullable_vector(["mag", "size"]))
    rows = rows.withColumn("union", F.concat("delta", "block"))
    trees = {"estimator": RoutedTrees()}
    return D.score_grid(
        rows, {"vector": "delta", "group_features": "block", "union": "union"}, {"family": "family"}, row_id="row_id", label="cls", classes=THREE, n_folds=5,
        options={"group_features": trees, "union": trees},
    )


@query("d12_feature_class_ablation")
def d12(spark, sf):
    a = G.family_residuals(B.attributes(spark, sf), family="family", values=["price", "size"])
    a = a.withColumn("cls", F.concat(F.lit("c"), (F.col("gene") % 3).cast("string"))).withColumnRenamed("gene", "row_id").withColumn("gene", F.col("row_id") % 100)
    a = a.join(P.group_folds(a, "gene", 5, 0), "gene")
    cols = ["price", "price_residual", "size", "size_residual"]
    return D.feature_class_ablation(a, cols, {"price": ["price"], "size": ["size"]}, row_id="row_id", label="cls", classes=THREE, estimator=RoutedTrees(), n_folds=5)


_REG = f"""WITH {B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'family', 3, 0, 'folds')}, v AS (SELECT CASE WHEN label = 'F' THEN 1 ELSE 0 END AS y, score, fold, gene % 4 = 0 AS seen FROM variants JOIN folds USING (family)),
    r AS (SELECT 'ALL' AS regime, * FROM v UNION ALL SELECT CASE WHEN seen THEN 'IN' ELSE 'OUT' END, * FROM v), n AS (SELECT regime, count(*) AS n_regime FROM r GROUP BY 1), u AS ({ranking_sql('r', 'regime, fold')})
    SELECT regime, fold, n_regime, round(CASE WHEN n_regime >= 5000 THEN auroc END, 6) AS auroc, CASE WHEN n_regime < 5000 THEN 'too few rows' END AS skip FROM u JOIN n USING (regime)"""


@query("d13_overlap_regimes", _REG)
def d13(spark, sf):
    rows = B.variants(spark, sf)
    v = rows.join(P.group_folds(rows, "family", 3, 0), "family").select((F.col("label") == "F").cast("int").alias("y"), "score", "fold", "gene")
    return rounded(D.overlap_regimes(v, F.col("gene") % 4 == 0, y="y", score="score", fold="fold", min_rows=5000), "auroc")


@query("d14_group_class_task")
def d14(spark, sf):
    """A class per group: mean vectors against table features."""
    v = B.vectors(spark, sf)
    g = V.group_mean(v, keys=["gene"], vec="vec").withColumn("cls", F.concat(F.lit("c"), (F.col("gene") % 3).cast("string")))
    g = g.withColumns({"row_id": F.col("gene"), "family": F.pmod("gene", F.lit(17)), "table": F.array(F.col("n").cast("double"), norm("vec"))})
    return D.score_grid(g, {"embedding": "vec", "table": "table"}, {"group": "gene", "family": "family"}, row_id="row_id", label="cls", classes=THREE, n_folds=5)


@query("d15_sensitivity_rerun")
def d15(spark, sf):
    """The split gap on one source only, and with window-averaged vectors on all rows."""
    rows = three(pair_rows(spark, sf)).withColumn("win", F.col("row_id") % 2)
    averaged = V.two_level_mean(rows.select("row_id", "gene", "win", "wt"), protein="gene", window="win", vec="wt").select("row_id", "protein_mean")
    rows = rows.join(averaged, "row_id")
    arms = {"wt": "wt", "wt_averaged": "protein_mean"}
    options = {"row_id": "row_id", "label": "cls", "classes": THREE, "n_folds": 2}
    whole = D.score_grid(rows, arms, {"family": "family"}, **options).withColumn("cohort", F.lit("all"))
    one = D.score_grid(rows.where("win = 0"), {"wt": "wt"}, {"family": "family"}, **options).withColumn("cohort", F.lit("single_source"))
    return whole.unionByName(one)


def run_documents(spark, sf, new):
    """One result document per customer; the second run moves, changes, adds and removes leaves."""
    k = F.col("c_custkey")
    mean = F.col("c_acctbal") + (F.when(k % 3 == 0, 5.0).otherwise(0.5) if new else F.lit(0.0))
    verdict = F.when(k % 4 == 0, "fail").otherwise("pass") if new else F.lit("pass")
    extra = F.when(k % 5 == 0, F.concat(F.lit(',"extra":'), k.cast("string"))).otherwise(F.lit(""))
    tail = extra if new else F.when(k % 6 == 0, F.lit(',"old_note":null')).otherwise(F.lit(""))
    doc = F.concat(
        F.lit('{"cell":{"mean":'), mean.cast("decimal(18,2)").cast("string"), F.lit(',"seed_std":'), (k % 2).cast("string"), F.lit('.25,"state":"'),
        F.when(k % 7 == 0, "unavailable").otherwise("available"), F.lit('"},"verdict":"'), verdict, F.lit('","n":['), (k % 10 + (1 if new else 0) * (k % 8 == 0).cast("int")).cast("string"), F.lit("]"), tail, F.lit("}"),
    )
    return flatten_json(T(spark, sf, "customer").select(k.alias("doc_id"), doc.alias("doc")), keys=["doc_id"], document="doc", max_depth=3)


_CMP = """WITH k AS (SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS m1, CAST(c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 5.0 ELSE 0.5 END AS DECIMAL(18,2)) AS m2 FROM customer),
    l AS (SELECT CASE WHEN abs(m2::DOUBLE - m1::DOUBLE) > CASE WHEN k % 7 = 0 THEN 0.005 ELSE (k % 2) + 0.25 END THEN 'moved' ELSE 'unchanged' END AS state, true AS num, k % 7 <> 0 AS sd FROM k
      UNION ALL SELECT 'unchanged', true, false FROM k UNION ALL SELECT 'unchanged', false, false FROM k
      UNION ALL SELECT CASE WHEN k % 4 = 0 THEN 'changed' ELSE 'unchanged' END, false, false FROM k
      UNION ALL SELECT CASE WHEN k % 8 = 0 THEN 'moved' ELSE 'unchanged' END, true, false FROM k
      UNION ALL SELECT 'added', false, false FROM k WHERE k % 5 = 0 UNION ALL SELECT 'removed', false, false FROM k WHERE k % 6 = 0)
    SELECT state, count(*) AS n, count(*) FILTER (num AND NOT sd) AS n_fallback FROM l GROUP BY state"""


@query("d16_compare_runs", _CMP)
def d16(spark, sf):
    return D.comparison_counts(D.compare_runs(run_documents(spark, sf, False), run_documents(spark, sf, True), keys=["doc_id"]))


@query(
    "d17_cohort_accounting",
    f"""WITH {B.VARIANTS_SQL}, n AS (SELECT gene, label, count(*) AS n FROM variants GROUP BY 1, 2), g AS (SELECT gene, label, sum(n) OVER (PARTITION BY gene) AS r FROM n QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, label) = 1)
    SELECT label, count(*) AS n_before, count(*) FILTER (r < 9) AS n_excluded, count(*) FILTER (r >= 9) AS n_after FROM g GROUP BY ROLLUP (label)""",
)
def d17(spark, sf):
    return D.cohort_accounting(B.variants(spark, sf), group="gene", label="label", min_rows=9)


@query(
    "d17_family_sizes",
    f"""WITH {B.ATTRIBUTES_SQL} SELECT size, count(*) AS n_families FROM (SELECT family, count(DISTINCT gene) AS size FROM attributes WHERE family IS NOT NULL GROUP BY 1) GROUP BY 1""",
)
def d17_sizes(spark, sf):
    return D.family_sizes(B.attributes(spark, sf), family="family", gene="gene")


@query("d18_probe_grid")
def d18(spark, sf):
    """Raw and projected vectors on a three-class and a two-class task."""
    rows = three(pair_rows(spark, sf))
    basis = V.aligned_subspace(stability_rows(spark, sf), vec="delta", target="t", n_components=3)
    rows = V.project_out(rows, vec="delta", basis=basis, out="projected").withColumn("two", F.when(F.col("cls") == "c0", "c0").otherwise("rest"))
    arms, schemes = {"raw": "delta", "projected": "projected"}, {"family": "family"}
    keep = {"projected": {"scale": False}, "raw": {"scale": False}}
    a = D.score_grid(rows, arms, schemes, row_id="row_id", label="cls", classes=THREE, n_folds=5, options=keep).withColumn("task", F.lit("three_class"))
    b = D.score_grid(rows, arms, schemes, row_id="row_id", label="two", classes=("c0", "rest"), n_folds=5, options=keep).withColumn("task", F.lit("two_class"))
    return a.unionByName(b)


