"""T: metrics as aggregations."""

from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.operators import metrics as M
from kinfold.plans import bindings as B

T = B.table
C = B.CLASSES
P = B.predictions_sql()
PR = f"{P}, q AS (SELECT *, {B.PRED_SQL} AS pred FROM preds)"


def preds(spark, sf, **kw):
    return M.predicted(B.predictions(spark, sf, **kw), proba="proba", classes=C)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


@query(
    "t1_confusion",
    f"""WITH {PR}, k AS (SELECT f.fold, a.y, b.pred FROM (SELECT DISTINCT fold FROM q) f, (SELECT unnest(['F', 'O', 'P']) AS y) a, (SELECT unnest(['F', 'O', 'P']) AS pred) b)
    SELECT k.fold, k.y, k.pred, count(row_id) AS n FROM k LEFT JOIN q ON q.fold = k.fold AND q.label = k.y AND q.pred = k.pred GROUP BY ALL""",
)
def t1(spark, sf):
    return M.confusion(preds(spark, sf), y="label", pred="pred", classes=C, keys=["fold"])


def class_metrics_sql(src, keys, w="1"):
    """Macro-F1 and balanced accuracy per key set, from weighted counts."""
    k = (keys + ", ") if keys else ""
    per = ", ".join(
        f"sum({w}) FILTER (label = '{c}' AND pred = '{c}') AS tp{i}, sum({w}) FILTER (label = '{c}') AS s{i}, sum({w}) FILTER (pred = '{c}') AS q{i}" for i, c in enumerate(C)
    )
    f1 = [f"coalesce(2.0::DOUBLE * coalesce(tp{i}, 0) / nullif(coalesce(s{i}, 0) + coalesce(q{i}, 0), 0), 0)" for i in range(3)]
    rec = " + ".join(f"coalesce(tp{i}, 0)::DOUBLE / s{i}" for i in range(3))
    g = f"GROUP BY {keys}" if keys else ""
    return f"SELECT {k} CAST(n AS BIGINT) AS n, ({' + '.join(f1)}) / 3 AS macro_f1, ({rec}) / 3 AS balanced_accuracy, {', '.join(f'{f1[i]} AS f1_{C[i]}' for i in range(3))} FROM (SELECT {k} sum({w}) AS n, {per} FROM {src} {g})"


@query(
    "t1_class_metrics",
    f"WITH {PR} SELECT fold, n, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1_F, 6) AS f1_F, round(f1_O, 6) AS f1_O, round(f1_P, 6) AS f1_P FROM ({class_metrics_sql('q', 'fold')})",
)
def t1_metrics(spark, sf):
    m = M.class_metrics(preds(spark, sf), y="label", pred="pred", classes=C, keys=["fold"])
    return rounded(m, "macro_f1", "balanced_accuracy", "f1_F", "f1_O", "f1_P")


def ranking_sql(src, keys, y="y", score="score", w="1"):
    """Tie-aware AUROC and step average precision from window sums."""
    part = f"PARTITION BY {keys}" if keys else ""
    k = (keys + ", ") if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k} CAST(sum(wp) AS BIGINT) AS n_pos, CAST(sum(wn) AS BIGINT) AS n_neg,
      CASE WHEN sum(wp) > 0 AND sum(wn) > 0 THEN sum(wp * (nle - neq / 2.0))::DOUBLE / (sum(wp)::DOUBLE * sum(wn)) END AS auroc,
      CASE WHEN sum(wp) > 0 AND sum(wn) > 0 THEN sum(CASE WHEN wp > 0 THEN wp * pge::DOUBLE / (pge + nge) ELSE 0 END) / sum(wp) END AS average_precision FROM (
      SELECT {k} wp, wn, sum(wn) OVER (PARTITION BY {k} s) AS neq, sum(wn) OVER ({part} ORDER BY s) AS nle, sum(wp) OVER ({part} ORDER BY s DESC) AS pge, sum(wn) OVER ({part} ORDER BY s DESC) AS nge
      FROM (SELECT {k} {score} AS s, CASE WHEN {y} = 1 THEN {w} ELSE 0 END AS wp, CASE WHEN {y} = 1 THEN 0 ELSE {w} END AS wn FROM {src} WHERE {score} IS NOT NULL)) {g}"""


def ovr_sql(src, keep, extra=""):
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS cls, CASE WHEN label = '{c}' THEN 1 ELSE 0 END AS y, proba[{i + 1}] AS score {extra} FROM {src}" for i, c in enumerate(C))


@query(
    "t2_auroc_one_vs_rest",
    f"WITH {P}, o AS ({ovr_sql('preds', 'fold')}) SELECT fold, cls, n_pos, n_neg, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM ({ranking_sql('o', 'fold, cls')})",
)
def t2(spark, sf):
    rows = M.one_vs_rest(B.predictions(spark, sf), y="label", proba="proba", classes=C, keep=["fold"])
    return rounded(M.ranking_metrics(rows, y="target", score="score", keys=["fold", "cls"]), "auroc", "average_precision")


@query(
    "t2_macro_auroc",
    f"WITH {P}, o AS ({ovr_sql('preds', 'fold')}) SELECT fold, round(CASE WHEN count(auroc) = 3 THEN avg(auroc) END, 6) AS macro_auroc FROM ({ranking_sql('o', 'fold, cls')}) GROUP BY fold",
)
def t2_macro(spark, sf):
    return rounded(M.macro_auroc(B.predictions(spark, sf), y="label", proba="proba", classes=C, keys=["fold"]), "macro_auroc")


@query(
    "t3_average_precision",
    f"WITH {B.BINARY_SQL} SELECT n_pos, n_neg, round(average_precision, 6) AS average_precision FROM ({ranking_sql('binrows', '')})",
)
def t3(spark, sf):
    return rounded(M.ranking_metrics(B.binary(spark, sf), y="y", score="score").select("n_pos", "n_neg", "average_precision"), "average_precision")


@query(
    "t4_prevalence_cut",
    f"""WITH {B.BINARY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, row_id) AS k, count(*) OVER (PARTITION BY gene) AS n, sum(y) OVER (PARTITION BY gene) AS p FROM binrows)
    SELECT gene, n, round(p / n, 6) AS prevalence, CAST(p AS BIGINT) AS flagged, round(CASE WHEN p > 0 AND p < n THEN sum(y) FILTER (k <= p)::DOUBLE / p END, 6) AS ppv,
    round(CASE WHEN p > 0 AND p < n THEN sum(1 - y) FILTER (k > p)::DOUBLE / (n - p) END, 6) AS npv FROM r GROUP BY gene, n, p""",
)
def t4(spark, sf):
    return rounded(M.prevalence_cut(B.binary(spark, sf), y="y", score="score", row_id="row_id", keys=["gene"]), "prevalence", "ppv", "npv")


@query(
    "t5_aggregate_folds",
    f"""WITH {PR}, m AS ({class_metrics_sql('q', 'fold')}), l AS (SELECT fold, 'macro_f1' AS metric, macro_f1 AS v FROM m UNION ALL SELECT fold, 'balanced_accuracy', CASE WHEN fold <> 2 THEN balanced_accuracy END FROM m)
    SELECT metric, round(CASE WHEN count(v) = 5 THEN avg(v) END, 6) AS mean, round(CASE WHEN count(v) = 5 THEN stddev_pop(v) END, 6) AS std, count(v) AS contributing,
    CASE WHEN count(v) <> 5 THEN 'metric unavailable in one or more required folds' END AS reason FROM l GROUP BY metric""",
)
def t5(spark, sf):
    m = M.class_metrics(preds(spark, sf), y="label", pred="pred", classes=C, keys=["fold"])
    m = m.withColumn("balanced_accuracy", F.when(F.col("fold") != 2, F.col("balanced_accuracy")))
    return rounded(M.aggregate_folds(m, values=["macro_f1", "balanced_accuracy"], n_folds=5), "mean", "std")


@query(
    "t6_auroc_at_median",
    f"WITH {B.VARIANTS_SQL}, m AS (SELECT family, quantile_cont(score, 0.5) AS med FROM variants GROUP BY 1), b AS (SELECT family, CASE WHEN score >= med THEN 1 ELSE 0 END AS y, gene_score AS s0 FROM variants JOIN m USING (family)) "
    f"SELECT family, n_pos, n_neg, round(auroc, 6) AS auroc FROM ({ranking_sql('b', 'family', score='s0')})",
)
def t6(spark, sf):
    m = M.auroc_at_median(B.variants(spark, sf), y="score", score="gene_score", keys=["family"])
    return rounded(m.select("family", "n_pos", "n_neg", "auroc"), "auroc")


_VOTE = B.predictions_sql().replace("o_orderstatus AS label", "substr('FOP', CAST(1 + o_custkey % 3 AS BIGINT), 1) AS label")


def gene_labelled(spark, sf):
    """Predictions whose label is a property of the group."""
    rows = B.variants(spark, sf).withColumn("label", F.substring(F.lit("FOP"), (1 + F.col("gene") % 3).cast("int"), F.lit(1)))
    return B.with_shares(rows.join(B.group_folds(rows, "gene", 5, 0), "gene"), "a")


@query(
    "t7_group_vote",
    f"""WITH {_VOTE}, g AS (SELECT gene, min(label) AS label, [avg(proba[1]), avg(proba[2]), avg(proba[3])] AS proba FROM preds GROUP BY 1), q AS (SELECT *, {B.PRED_SQL} AS pred FROM g)
    SELECT n, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM ({class_metrics_sql('q', '')})""",
)
def t7(spark, sf):
    votes = M.group_vote(gene_labelled(spark, sf), group="gene", y="label", proba="proba", classes=C)
    return rounded(M.class_metrics(votes, y="label", pred="pred", classes=C).select("n", "macro_f1", "balanced_accuracy"), "macro_f1", "balanced_accuracy")


def spearman_sql(src, keys, x, y):
    part = f"PARTITION BY {keys}" if keys else ""
    k = (keys + ", ") if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    eq = lambda c: f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k} {c}) - 1) / 2.0)"
    return f"SELECT {k} count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {k} {eq(x)} AS rx, {eq(y)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {g}"


@query("t8_spearman", f"WITH {B.VARIANTS_SQL} SELECT family, n, round(rho, 6) AS rho FROM ({spearman_sql('variants', 'family', 'score', 'gene_score')})")
def t8(spark, sf):
    return rounded(M.spearman(B.variants(spark, sf), ["family"], x="score", y="gene_score"), "rho")


@query("t8_pearson", f"WITH {B.VARIANTS_SQL} SELECT source, count(*) AS n, round(corr(score, gene_score), 6) AS r FROM variants GROUP BY source")
def t8_pearson(spark, sf):
    return rounded(M.weighted_correlation(B.variants(spark, sf), ["source"], x="score", y="gene_score"), "r")


_FAM = f"per AS (SELECT * FROM ({ranking_sql('binrows', 'family')}) WHERE n_pos >= 5 AND n_neg >= 5)"


@query(
    "t9_family_report",
    f"""WITH {B.BINARY_SQL}, {_FAM} SELECT 'overall' AS scope, NULL AS family, n_pos, n_neg, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM ({ranking_sql('binrows', '')})
    UNION ALL SELECT 'family', family, n_pos, n_neg, round(auroc, 6), round(average_precision, 6) FROM per""",
)
def t9(spark, sf):
    return rounded(M.family_report(B.binary(spark, sf), y="y", score="score", family="family", min_pos=5, min_neg=5), "auroc", "average_precision")


_BIG = f"v AS (SELECT family, CASE WHEN label = 'F' THEN 1 ELSE 0 END AS y, score FROM variants), per AS (SELECT * FROM ({ranking_sql('v', 'family')}) WHERE n_pos >= 10 AND n_neg >= 10)"


def _family_scores(spark, sf):
    rows = B.variants(spark, sf).select("family", (F.col("label") == "F").cast("int").alias("y"), "score")
    return M.family_report(rows, y="y", score="score", family="family")


@query(
    "t9_family_distribution",
    f"""WITH {B.VARIANTS_SQL}, {_BIG} SELECT count(*) AS n_families, round(avg(auroc), 6) AS mean, round(stddev_pop(auroc), 6) AS std, round(min(auroc), 6) AS min, round(max(auroc), 6) AS max,
    round(avg(CASE WHEN auroc < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS share_below_0_8, round(avg(CASE WHEN auroc < 0.7 THEN 1.0 ELSE 0.0 END), 6) AS share_below_0_7,
    round(quantile_cont(auroc, 0.25), 6) AS q25, round(quantile_cont(auroc, 0.5), 6) AS median, round(quantile_cont(auroc, 0.75), 6) AS q75, round(quantile_cont(auroc, 0.75) - quantile_cont(auroc, 0.25), 6) AS iqr FROM per""",
)
def t9_dist(spark, sf):
    d = M.family_distribution(_family_scores(spark, sf))
    return rounded(d, *[c for c in d.columns if c != "n_families"])


@query(
    "t9_extremes",
    f"""WITH {B.VARIANTS_SQL}, {_BIG} SELECT * FROM (SELECT family::VARCHAR AS family, round(auroc, 6) AS auroc, 'worst' AS "end" FROM per ORDER BY per.auroc, family::VARCHAR LIMIT 5)
    UNION ALL SELECT * FROM (SELECT family::VARCHAR, round(auroc, 6), 'best' FROM per ORDER BY per.auroc DESC, family::VARCHAR LIMIT 5)""",
)
def t9_ends(spark, sf):
    per = _family_scores(spark, sf).where("scope = 'family'").select("family", "auroc")
    return rounded(M.extremes(per, value="auroc", tie="family"), "auroc")


_ASSAY = """a AS (SELECT l_suppkey AS assay, l_extendedprice AS target, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_linenumber % 4 <> 0 AND l_suppkey % 10 <> 3 THEN l_quantity END AS score FROM lineitem),
    s AS (SELECT assay, target, y, -score AS score FROM a WHERE score IS NOT NULL)"""


@query(
    "t10_assay_report",
    f"""WITH {_ASSAY}, n AS (SELECT assay, count(*) AS n, count(score) AS n_scored FROM a GROUP BY 1), r AS ({spearman_sql('s', 'assay', 'score', 'target')}), u AS ({ranking_sql('s', 'assay')}),
    j AS (SELECT assay, n.n, n_scored, rho, auroc, CASE WHEN n_scored < 20 THEN 'too_few_scored' WHEN rho IS NULL THEN 'constant' WHEN auroc IS NULL THEN 'one_class' END AS skip FROM n LEFT JOIN r USING (assay) LEFT JOIN u USING (assay))
    SELECT assay, n, n_scored, round(n_scored / n, 6) AS coverage, skip, round(CASE WHEN skip IS NULL THEN rho END, 6) AS rho, round(CASE WHEN skip IS NULL THEN auroc END, 6) AS auroc FROM j""",
)
def t10(spark, sf):
    a = T(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("assay"), F.col("l_extendedprice").alias("target"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when((F.col("l_linenumber") % 4 != 0) & (F.col("l_suppkey") % 10 != 3), F.col("l_quantity")).alias("score"),
    )
    return rounded(M.assay_report(a, assay="assay", target="target", binary="y", score="score", sign=-1), "coverage", "rho", "auroc")


@query(
    "t11_calibration_error",
    f"""WITH {P}, b AS (SELECT fold, proba[1] AS p, CASE WHEN label = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN proba[1] < 1 THEN {' + '.join(f'(proba[1] >= {i * 0.1!r}::DOUBLE)::INT' for i in range(1, 10))} END AS bin FROM preds),
    g AS (SELECT fold, bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM b GROUP BY 1, 2), t AS (SELECT fold, sum(n) AS t FROM g GROUP BY 1)
    SELECT fold, round(sum(n / t * abs(a - c)), 6) AS ece, CAST(sum(n) AS BIGINT) AS n_binned FROM g JOIN t USING (fold) WHERE bin IS NOT NULL GROUP BY fold""",
)
def t11(spark, sf):
    rows = B.predictions(spark, sf).select("fold", F.get("proba", F.lit(0)).alias("p"), (F.col("label") == "F").cast("int").alias("y"))
    return rounded(M.calibration_error(rows, y="y", p="p", keys=["fold"]), "ece")


@query(
    "t12_operating_point",
    f"""WITH {P}, b AS (SELECT source, proba[1] AS p, CASE WHEN label = 'F' THEN 1 ELSE 0 END AS y FROM preds)
    SELECT source, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, count(*) FILTER (p >= 0.4) AS flagged, round(count(*) FILTER (p >= 0.4 AND y = 1)::DOUBLE / sum(y), 6) AS recall, round(count(*) FILTER (p >= 0.4 AND y = 1)::DOUBLE / count(*) FILTER (p >= 0.4), 6) AS precision FROM b GROUP BY source""",
)
def t12(spark, sf):
    rows = B.predictions(spark, sf).select("source", F.get("proba", F.lit(0)).alias("p"), (F.col("label") == "F").cast("int").alias("y"))
    return rounded(M.operating_point(rows, y="y", score="p", keys=["source"]), "recall", "precision")


@query("t12_missed_positives", f"WITH {P} SELECT row_id, round(proba[1], 6) AS p FROM preds WHERE label = 'F' AND proba[1] < 0.2")
def t12_out(spark, sf):
    rows = B.predictions(spark, sf).select("row_id", F.get("proba", F.lit(0)).alias("p"), (F.col("label") == "F").cast("int").alias("y"))
    return M.outliers(rows, y="y", score="p", threshold=0.2).select("row_id", F.round("p", 6).alias("p"))


@query(
    "t13_review_lists",
    f"""WITH {P}, o AS ({ovr_sql('preds', 'row_id')}) SELECT row_id, cls, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY cls ORDER BY o.score DESC, row_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 20""",
)
def t13(spark, sf):
    return rounded(M.review_lists(B.predictions(spark, sf), row_id="row_id", proba="proba", classes=C), "score")


@query(
    "t13_disagreement",
    f"WITH {PR}, {B.shares_sql('joined', 'b', 'pb')}, r AS (SELECT row_id, {B.PRED_SQL} AS pred_b FROM pb) SELECT pred AS pred_a, pred_b, count(*) AS n FROM q JOIN r USING (row_id) GROUP BY ALL",
)
def t13_dis(spark, sf):
    a = preds(spark, sf).select("row_id", F.col("pred").alias("a"))
    b = preds(spark, sf, arm="b").select("row_id", F.col("pred").alias("b"))
    return M.disagreement(a.join(b, "row_id"), a="a", b="b")


@query(
    "t14_log_summary",
    f"""WITH {B.LOG_SQL}, l AS (SELECT latency, outcome = 'error' AS bad, outcome = 'purchase' AS ok, CAST(props->>'k' AS BIGINT) AS k FROM prediction_log),
    o AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM l)
    SELECT count(*) AS n, count(*) FILTER (bad) AS n_failed, CAST(sum(k % 3) AS BIGINT) AS n_retries, CAST(sum(k) AS BIGINT) AS n_tokens, round(count(*) FILTER (ok AND NOT bad)::DOUBLE / count(*) FILTER (NOT bad), 6) AS accuracy,
    (SELECT latency FROM o WHERE i = floor(0.5 * n)) AS p50, (SELECT latency FROM o WHERE i = floor(0.95 * n)) AS p95 FROM l""",
)
def t14(spark, sf):
    log = B.prediction_log(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    s = M.log_summary(
        log, outcome="outcome", ok=F.col("outcome") == "purchase", failed=F.col("outcome") == "error", retries=F.col("k") % 3, tokens=F.col("k"), latency="latency"
    )
    return rounded(s, "accuracy")


@query("t15_predicted_class", f"WITH {PR} SELECT row_id, pred FROM q")
def t15(spark, sf):
    return preds(spark, sf).select("row_id", "pred")
