"""Metrics as aggregations. Every one takes grouping keys and an optional row weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.ranking import exact_quantiles, prefix_sums, rank_table, value_rank
from kinfold.functions.rows import attach_row, attach_totals
from kinfold.functions.vector_expr import argmax_label


def _weight(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def _mean(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0]) / F.lit(float(len(columns)))


def predicted(df: DataFrame, *, proba: str, classes: Sequence, out: str = "pred") -> DataFrame:
    """The class with the largest share, in declared order on ties."""
    return df.withColumn(out, argmax_label(proba, classes))


def confusion(df: DataFrame, *, y: str, pred: str, classes: Sequence, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, y, pred, n) over every pair of declared classes; unseen pairs are zero."""
    cells = [
        F.sum(F.when((F.col(y) == a) & (F.col(pred) == b), _weight(weight)).otherwise(0)).alias(f"_{i}_{j}")
        for i, a in enumerate(classes)
        for j, b in enumerate(classes)
    ]
    wide = df.groupBy(*keys).agg(*cells)
    entries = [
        F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred"), F.col(f"_{i}_{j}").alias("n"))
        for i, a in enumerate(classes)
        for j, b in enumerate(classes)
    ]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.y", "_e.pred", "_e.n")


def class_metrics(df: DataFrame, *, y: str, pred: str, classes: Sequence, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n, per-class F1, macro-F1 and balanced accuracy (null when a declared class is absent), in one aggregation."""
    w = _weight(weight)
    aggs = [F.sum(w).alias("n")]
    for i, c in enumerate(classes):
        aggs += [
            F.sum(F.when((F.col(y) == c) & (F.col(pred) == c), w).otherwise(0)).alias(f"_tp{i}"),
            F.sum(F.when(F.col(y) == c, w).otherwise(0)).alias(f"_s{i}"),
            F.sum(F.when(F.col(pred) == c, w).otherwise(0)).alias(f"_q{i}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    k = range(len(classes))
    f1 = [F.coalesce(2 * F.col(f"_tp{i}") / F.nullif(F.col(f"_s{i}") + F.col(f"_q{i}"), F.lit(0)), F.lit(0.0)) for i in k]
    recall = [F.col(f"_tp{i}") / F.nullif(F.col(f"_s{i}"), F.lit(0)) for i in k]
    return wide.select(
        *keys, "n", _mean(f1).alias("macro_f1"), _mean(recall).alias("balanced_accuracy"), *[f1[i].alias(f"f1_{classes[i]}") for i in k]
    )


def one_vs_rest(df: DataFrame, *, y: str, proba: str, classes: Sequence, keep: Sequence[str]) -> DataFrame:
    """(keep, cls, target, score): one row per row and declared class."""
    parts = F.array(
        *[
            F.struct(F.lit(str(c)).alias("cls"), (F.col(y) == c).cast("int").alias("target"), F.get(proba, F.lit(i)).alias("score"))
            for i, c in enumerate(classes)
        ]
    )
    return df.select(*keep, F.explode(parts).alias("_e")).select(*keep, "_e.*")


def ranking_metrics(df: DataFrame, *, y: str, score: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n_pos, n_neg, tie-aware AUROC and step average precision; null when the target is constant."""
    w = _weight(weight)
    table = prefix_sums(
        df.where(F.col(score).isNotNull()), list(keys), score,
        {"_p": F.when(F.col(y) == 1, w).otherwise(0), "_q": F.when(F.col(y) == 1, 0).otherwise(w)},
    )
    p_total, q_total = F.max("_p_total"), F.max("_q_total")
    wins = F.sum(F.col("_p") * (F.col("_q_before") + F.col("_q") / 2.0))
    above_p = F.col("_p_total") - F.col("_p_before")
    above = above_p + F.col("_q_total") - F.col("_q_before")
    steps = F.sum(F.when(F.col("_p") > 0, F.col("_p") * above_p / above))
    usable = (p_total > 0) & (q_total > 0)
    return table.groupBy(*keys).agg(
        p_total.alias("n_pos"),
        q_total.alias("n_neg"),
        F.when(usable, wins / (p_total.cast("double") * q_total)).alias("auroc"),
        F.when(usable, steps / p_total).alias("average_precision"),
    )


def macro_auroc(df: DataFrame, *, y: str, proba: str, classes: Sequence, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean one-vs-rest AUROC; null when any declared class has none."""
    keep = [*keys, *([weight] if weight else [])]
    per = ranking_metrics(
        one_vs_rest(df, y=y, proba=proba, classes=classes, keep=keep), y="target", score="score", keys=[*keys, "cls"], weight=weight
    )
    return per.groupBy(*keys).agg(F.when(F.count("auroc") == len(classes), F.avg("auroc")).alias("macro_auroc"))


def prevalence_cut(df: DataFrame, *, y: str, score: str, row_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """PPV and NPV when as many rows are flagged as the prevalence says; equal scores go by row id."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("n_pos"))
    size = size.withColumn("prevalence", F.col("n_pos") / F.col("n")).withColumn(
        "flagged", F.bround(F.col("prevalence") * F.col("n")).cast("long")
    )
    ranked = value_rank(df, keys, score, tie=row_id, out="_r", descending=True)
    joined = attach_totals(ranked, size, keys)
    top = F.col("_r") < F.col("flagged")
    out = joined.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("n_pos").alias("n_pos"), F.first("prevalence").alias("prevalence"), F.first("flagged").alias("flagged"),
        F.sum(F.when(top, F.col(y)).otherwise(0)).alias("_tp"), F.sum(F.when(~top, 1 - F.col(y)).otherwise(0)).alias("_tn"),
    )
    inner = (F.col("flagged") > 0) & (F.col("flagged") < F.col("n"))
    return out.select(
        *keys, "n", "prevalence", "flagged",
        F.when(inner, F.col("_tp") / F.col("flagged")).alias("ppv"),
        F.when(inner, F.col("_tn") / (F.col("n") - F.col("flagged"))).alias("npv"),
    )


def aggregate_folds(df: DataFrame, *, values: Sequence[str], n_folds: int, keys: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """(keys, metric, mean, std, contributing): null unless every requested fold contributed."""
    long = df.unpivot([*keys, fold], list(values), "metric", "value")
    g = long.groupBy(*keys, "metric").agg(
        F.count("value").alias("contributing"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")
    )
    full = F.col("contributing") == n_folds
    return g.select(
        *keys, "metric", F.when(full, F.col("_m")).alias("mean"), F.when(full, F.col("_s")).alias("std"), "contributing",
        F.when(~full, "metric unavailable in one or more required folds").alias("reason"),
    )


def mean_std_n(df: DataFrame, *, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and count over the values that exist."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def auroc_at_median(df: DataFrame, *, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC with rows at or above the target's median as positives."""
    keys = list(keys)
    median = exact_quantiles(df, keys, y, {"_median": 0.5})
    joined = attach_totals(df, median, keys)
    return ranking_metrics(joined.withColumn("_y", (F.col(y) >= F.col("_median")).cast("int")), y="_y", score=score, keys=keys)


def group_vote(df: DataFrame, *, group: str, y: str, proba: str, classes: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: its label, mean shares and voted class. A group with two labels raises."""
    label = F.when(F.min(y) == F.max(y), F.min(y)).otherwise(
        F.raise_error(F.concat(F.lit("group with more than one label: "), F.first(F.col(group).cast("string"))))
    )
    g = df.groupBy(*keys, group).agg(
        label.alias(y), F.array(*[F.avg(F.get(proba, F.lit(i))) for i in range(len(classes))]).alias("proba")
    )
    return g.withColumn("pred", argmax_label("proba", classes))


def spearman(df: DataFrame, keys: Sequence[str], *, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Mid-rank correlation per group with the number of rows; weights count a row that many times.

    The mean of mid-ranks is known, so one aggregation over the ranked cells ends it.
    """
    keys = list(keys)
    w = _weight(weight)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(*keys, x, y).agg(F.sum(w).alias("_cw")).where("_cw > 0")
    ranked = cells.join(rank_table(cells, keys, x, "_rx", "_cw"), [*keys, x]).join(
        rank_table(cells, keys, y, "_ry", "_cw").drop("_ry_total"), [*keys, y]
    )
    middle = (F.col("_rx_total") + 1) / 2
    a, b = F.col("_rx") - middle, F.col("_ry") - middle
    g = ranked.groupBy(*keys).agg(
        F.sum("_cw").alias("n"), F.sum(F.col("_cw") * a * b).alias("_c"), F.sum(F.col("_cw") * a * a).alias("_va"), F.sum(F.col("_cw") * b * b).alias("_vb")
    )
    return g.select(
        *keys, F.col("n").cast("long").alias("n"), F.when((F.col("_va") > 0) & (F.col("_vb") > 0), F.col("_c") / F.sqrt(F.col("_va") * F.col("_vb"))).alias("rho")
    )


def weighted_correlation(df: DataFrame, keys: Sequence[str], *, x: str, y: str, weight: str | None = None, out: str = "r") -> DataFrame:
    """Pearson correlation per group from one pass; a constant side gives null."""
    w = _weight(weight).cast("double")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    means = df.groupBy(*keys).agg(F.sum(w).alias("_n"), (F.sum(w * a) / F.sum(w)).alias("_ma"), (F.sum(w * b) / F.sum(w)).alias("_mb"))
    joined = attach_totals(df, means, keys)
    da, db = a - F.col("_ma"), b - F.col("_mb")
    g = joined.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.sum(w * da * db).alias("_c"), F.sum(w * da * da).alias("_va"), F.sum(w * db * db).alias("_vb")
    )
    return g.select(
        *keys, F.col("_n").cast("long").alias("n"),
        F.when((F.col("_va") > 0) & (F.col("_vb") > 0), F.col("_c") / F.sqrt(F.col("_va") * F.col("_vb"))).alias(out),
    )


def family_report(df: DataFrame, *, y: str, score: str, family: str, min_pos: int = 10, min_neg: int = 10) -> DataFrame:
    """Overall and per-family ranking quality; families with too few of a class are left out."""
    overall = ranking_metrics(df, y=y, score=score).select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("family"), "*")
    per = ranking_metrics(df.where(F.col(family).isNotNull()), y=y, score=score, keys=[family])
    per = per.where((F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg))
    named = per.select(F.lit("family").alias("scope"), F.col(family).cast("string").alias("family"), "n_pos", "n_neg", "auroc", "average_precision")
    return overall.unionByName(named)


def family_distribution(per_family: DataFrame) -> DataFrame:
    """Spread of per-family AUROC."""
    f = per_family.where("scope = 'family'")
    q = exact_quantiles(f, [], "auroc", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    s = f.agg(
        F.count("*").alias("n_families"), F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("std"), F.min("auroc").alias("min"), F.max("auroc").alias("max"),
        F.avg((F.col("auroc") < 0.8).cast("double")).alias("share_below_0_8"), F.avg((F.col("auroc") < 0.7).cast("double")).alias("share_below_0_7"),
    )
    return attach_row(s, q).withColumn("iqr", F.col("q75") - F.col("q25"))


def extremes(df: DataFrame, *, value: str, tie: str, n: int = 5) -> DataFrame:
    """The ``n`` lowest and highest rows, as two distributed top-n reports."""
    low = df.orderBy(value, tie).limit(n).withColumn("end", F.lit("worst"))
    high = df.orderBy(F.desc(value), tie).limit(n).withColumn("end", F.lit("best"))
    return low.unionByName(high)


def assay_report(df: DataFrame, *, assay: str, target: str, binary: str, score: str, min_rows: int = 20, sign: int = 1) -> DataFrame:
    """Per assay: coverage, rank correlation, AUROC and why an assay is skipped. ``sign`` −1 orients towards damage."""
    rows = df.withColumn("_s", F.col(score) * F.lit(sign))
    counts = rows.groupBy(assay).agg(F.count("*").alias("n"), F.count("_s").alias("n_scored"))
    scored = rows.where(F.col("_s").isNotNull())
    rho = spearman(scored, [assay], x="_s", y=target).select(assay, "rho")
    auc = ranking_metrics(scored, y=binary, score="_s", keys=[assay]).select(assay, "auroc")
    joined = counts.join(rho, assay, "left").join(auc, assay, "left")
    reason = F.when(F.col("n_scored") < min_rows, "too_few_scored").when(F.col("rho").isNull(), "constant").when(F.col("auroc").isNull(), "one_class")
    return joined.withColumns({"skip": reason, "coverage": F.col("n_scored") / F.col("n")}).withColumns(
        {c: F.when(F.col("skip").isNull(), F.col(c)) for c in ("rho", "auroc")}
    )


def calibration_error(df: DataFrame, *, y: str, p: str, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean gap between confidence and accuracy over bins ``[lo, hi)``; a probability of one is in no bin."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)]
    spot = sum([(F.col(p) >= e).cast("int") for e in edges[1:]], F.lit(0))
    binned = df.withColumn("_bin", F.when(F.col(p) < 1.0, spot))
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    g = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.avg(p).alias("_c"), F.avg(y).alias("_a"))
    g = g.withColumn("_t", F.sum("_n").over(total)).where(F.col("_bin").isNotNull())  # n_bins + 1 rows per key
    return g.groupBy(*keys).agg(F.sum(F.col("_n") / F.col("_t") * F.abs(F.col("_a") - F.col("_c"))).alias("ece"), F.sum("_n").alias("n_binned"))


def operating_point(df: DataFrame, *, y: str, score: str, threshold: float = 0.4, keys: Sequence[str] = ()) -> DataFrame:
    """Rows flagged at a threshold with recall and precision."""
    hit = F.col(score) >= threshold
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y).alias("n_pos"), F.count_if(hit).alias("flagged"), F.count_if(hit & (F.col(y) == 1)).alias("tp")
    )
    return g.select(
        *keys, "n", "n_pos", "flagged", (F.col("tp") / F.nullif("n_pos", F.lit(0))).alias("recall"), (F.col("tp") / F.nullif("flagged", F.lit(0))).alias("precision")
    )


def outliers(df: DataFrame, *, y: str, score: str, threshold: float = 0.4) -> DataFrame:
    """Positives the threshold misses."""
    return df.where((F.col(y) == 1) & (F.col(score) < threshold))


def review_lists(df: DataFrame, *, row_id: str, proba: str, classes: Sequence, n: int = 20) -> DataFrame:
    """The ``n`` rows with the largest share of every class, best first."""
    shares = [F.struct(F.lit(str(c)).alias("cls"), F.get(proba, F.lit(i)).alias("score")) for i, c in enumerate(classes)]
    ovr = df.select(row_id, F.explode(F.array(*shares)).alias("_e")).select(row_id, "_e.*")
    w = Window.partitionBy("cls").orderBy(F.desc("score"), row_id)
    return ovr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def disagreement(df: DataFrame, *, a: str, b: str) -> DataFrame:
    """Predicted class pairs of two arms with their counts."""
    return df.groupBy(F.col(a).alias("pred_a"), F.col(b).alias("pred_b")).agg(F.count("*").alias("n"))


def log_summary(df: DataFrame, *, outcome: str, ok: Column, failed: Column, retries: Column, tokens: Column, latency: str) -> DataFrame:
    """Accuracy over scored calls, failures, retries, token total, and latency at index ``int(f·n)``."""
    base = df.agg(
        F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.sum(retries).alias("n_retries"), F.sum(tokens).alias("n_tokens"),
        (F.count_if(ok & ~failed) / F.nullif(F.count_if(~failed), F.lit(0))).alias("accuracy"),
    )
    t = prefix_sums(df.where(F.col(latency).isNotNull()), [], latency, {"_n": F.lit(1)})
    upto = F.col("_n_before") + F.col("_n")
    at = [F.min(F.when(upto > F.floor(F.col("_n_total") * f), F.col(latency))).alias(name) for name, f in (("p50", 0.5), ("p95", 0.95))]
    return attach_row(base, t.agg(*at))
