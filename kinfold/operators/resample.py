"""Cluster bootstrap, subsampling and permutation inference.

Drawn rows are never materialised. A draw is a (boot, cluster, weight) table, rows
are first compressed to counts per cluster, and every metric takes the weight. A
statistic is an object with two methods: ``compress(df, cluster)`` reduces rows to
weighted cells per cluster, ``score(cells, keys)`` returns one value per key set.
Ranking and count statistics also have ``score_draws``, which scores all draws in one pass, and some ``score_blocks``,
which scores plain rows in blocks of draws, without a shuffle for the draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.rows import attach_row
from kinfold.functions.ranking import hash_rank, rank_table
from kinfold.operators import metrics as M
from kinfold.operators.draw_blocks import EVERY, Blocks, auroc_by_block, blocks, correlation_by_block, weights_by_draw
from kinfold.operators.draw_ranks import correlation_by_draw
from kinfold.operators.many_draws import auroc_by_draw, cell_draws, draw_table, hit_bytes, kept_bytes, permuted_rows, value_sums, weighted_rows
from kinfold.operators.shuffles import class_marks, class_sums, shuffled_labels
from kinfold.session import durable


def _fold_mean(per_fold: DataFrame, keys: Sequence[str], value: str, n_folds: int | None) -> DataFrame:
    """Mean over folds; null unless every fold has a value."""
    g = per_fold.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_k"))
    need = F.lit(n_folds) if n_folds else F.col("_k")
    return g.select(*keys, F.when((F.col("_k") == need) & (F.col("_k") > 0), F.col("_m")).alias("value"))


@dataclass(frozen=True)
class MacroF1:
    """Macro-F1 inside each fold, averaged over folds."""

    y: str
    pred: str
    classes: tuple
    fold: str
    n_folds: int

    def compress(self, df: DataFrame, cluster: str) -> DataFrame:
        return df.groupBy(cluster, self.fold, self.y, self.pred).agg(F.count("*").alias("_w"))

    def score(self, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        per = M.class_metrics(cells, y=self.y, pred=self.pred, classes=self.classes, keys=[*keys, self.fold], weight="_w")
        return _fold_mean(per, keys, "macro_f1", self.n_folds)

    def score_draws(self, cells: DataFrame, draws: DataFrame, cluster: str, n_boot: int) -> DataFrame:
        return self.score(cell_draws(cells, draws, cluster=cluster, keys=[self.fold, self.y, self.pred], n_draws=n_boot), ["boot"])

    def score_blocks(self, df: DataFrame, draws: Blocks, cluster: str) -> DataFrame:
        return self.score(weights_by_draw(df, draws, cluster=cluster, keys=[self.fold, self.y, self.pred]), ["boot"])


@dataclass(frozen=True)
class BinaryAuroc:
    """AUROC of a 0/1 target inside each fold, averaged over folds."""

    y: str
    score_col: str
    fold: str
    n_folds: int

    def compress(self, df: DataFrame, cluster: str, keys: Sequence[str] = ()) -> DataFrame:
        return df.groupBy(*keys, cluster, self.fold, self.y, self.score_col).agg(F.count("*").alias("_w"))

    def score(self, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        per = M.ranking_metrics(cells, y=self.y, score=self.score_col, keys=[*keys, self.fold], weight="_w")
        return _fold_mean(per, keys, "auroc", self.n_folds)

    def score_draws(self, cells: DataFrame, draws: DataFrame, cluster: str, n_boot: int) -> DataFrame:
        rows = weighted_rows(cells, draws, cluster=cluster, target=self.y, n_draws=n_boot)
        per = auroc_by_draw(rows, keys=[self.fold], score=self.score_col, n_draws=n_boot)
        return _fold_mean(per.withColumnRenamed("draw", "boot"), ["boot"], "auroc", self.n_folds)


@dataclass(frozen=True)
class MacroAuroc:
    """Mean one-vs-rest AUROC inside each fold, averaged over folds."""

    y: str
    proba: str
    classes: tuple
    fold: str
    n_folds: int

    def compress(self, df: DataFrame, cluster: str) -> DataFrame:
        rows = M.one_vs_rest(df, y=self.y, proba=self.proba, classes=self.classes, keep=[cluster, self.fold])
        return rows.groupBy(cluster, self.fold, "cls", "target", "score").agg(F.count("*").alias("_w"))

    def score(self, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        per = M.ranking_metrics(cells, y="target", score="score", keys=[*keys, self.fold, "cls"], weight="_w")
        return self._average(per, keys)

    def score_draws(self, cells: DataFrame, draws: DataFrame, cluster: str, n_boot: int) -> DataFrame:
        return self.score_rows(weighted_rows(cells, draws, cluster=cluster, target="target", n_draws=n_boot), n_boot)

    def score_blocks(self, df: DataFrame, draws: Blocks, cluster: str) -> DataFrame:
        rows = M.one_vs_rest(df, y=self.y, proba=self.proba, classes=self.classes, keep=[cluster, self.fold])
        return self._average(auroc_by_block(rows, draws, cluster=cluster, keys=[self.fold, "cls"], score="score", target="target"), ["boot"])

    def score_rows(self, rows: DataFrame, n_draws: int) -> DataFrame:
        per = auroc_by_draw(rows, keys=[self.fold, "cls"], score="score", n_draws=n_draws)
        return self._average(per.withColumnRenamed("draw", "boot"), ["boot"])

    def _average(self, per: DataFrame, keys: Sequence[str]) -> DataFrame:
        fold = per.groupBy(*keys, self.fold).agg(F.when(F.count("auroc") == len(self.classes), F.avg("auroc")).alias("_a"))
        return _fold_mean(fold, keys, "_a", self.n_folds)


@dataclass(frozen=True)
class SpearmanRho:
    """Rank correlation inside each fold, averaged over folds."""

    x: str
    y: str
    fold: str
    n_folds: int

    def compress(self, df: DataFrame, cluster: str) -> DataFrame:
        return df.groupBy(cluster, self.fold, self.x, self.y).agg(F.count("*").alias("_w"))

    def score(self, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        return _fold_mean(M.spearman(cells, [*keys, self.fold], x=self.x, y=self.y, weight="_w"), keys, "rho", self.n_folds)

    def score_draws(self, cells: DataFrame, draws: DataFrame, cluster: str, n_boot: int) -> DataFrame:
        per = correlation_by_draw(cells, draws, cluster=cluster, keys=[self.fold], x=self.x, y=self.y, n_draws=n_boot)
        return _fold_mean(per, ["boot"], "rho", self.n_folds)

    def score_blocks(self, df: DataFrame, draws: Blocks, cluster: str) -> DataFrame | None:
        per = correlation_by_block(df, draws, cluster=cluster, keys=[self.fold], x=self.x, y=self.y)
        return None if per is None else _fold_mean(per, ["boot"], "rho", self.n_folds)


@dataclass(frozen=True)
class MeanOf:
    """Plain mean of a column."""

    value: str

    def compress(self, df: DataFrame, cluster: str) -> DataFrame:
        return df.groupBy(cluster).agg(F.count(self.value).alias("_w"), F.sum(self.value).alias("_s"))

    def score(self, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        scale = F.col("_draws") if "_draws" in cells.columns else F.lit(1)
        return cells.groupBy(*keys).agg((F.sum(F.col("_s") * scale) / F.sum("_w")).alias("value"))

    def score_draws(self, cells: DataFrame, draws: DataFrame, cluster: str, n_boot: int) -> DataFrame:
        count, total = F.get("sums", F.lit(0)), F.get("sums", F.lit(1))
        return value_sums(cells, draws, cluster=cluster, values=["_w", "_s"], n_draws=n_boot).select("boot", F.when(count > 0, total / count).alias("value"))


def cluster_unit(family: str, gene: str, prefix: str = "gene_") -> Column:
    """The resampling unit: the family, or the gene itself when it has none."""
    return F.coalesce(F.col(family).cast("string"), F.concat(F.lit(prefix), F.col(gene).cast("string")))


def class_presence_strata(df: DataFrame, *, cluster: str, folds: Sequence[str], label: str) -> DataFrame:
    """(cluster, stratum): the folds a cluster sits in and the classes it holds.

    When any cluster spans two folds of an arm the stratum is null for all of them:
    the strata are unavailable and draws have to go without.
    """
    per = df.groupBy(cluster).agg(
        *[F.min(f).alias(f"_lo{i}") for i, f in enumerate(folds)],
        *[F.max(f).alias(f"_hi{i}") for i, f in enumerate(folds)],
        F.array_join(F.sort_array(F.collect_set(F.col(label).cast("string"))), ",").alias("_classes"),
    )
    spans = sum([(F.col(f"_lo{i}") != F.col(f"_hi{i}")).cast("int") for i in range(len(folds))], F.lit(0)) > 0
    bad = per.agg(F.count_if(spans).alias("_bad"))
    key = F.concat_ws("|", *[F.col(f"_lo{i}").cast("string") for i in range(len(folds))], F.col("_classes"))
    return attach_row(per, bad).select(cluster, F.when(F.col("_bad") == 0, key).alias("stratum"))


def _numbered(clusters: DataFrame, cluster: str) -> DataFrame:
    """(cluster, stratum, index, size): clusters numbered inside their stratum."""
    base = clusters.select(
        F.col(cluster).alias("_cluster"),
        (F.coalesce("stratum", F.lit("all")) if "stratum" in clusters.columns else F.lit("all")).alias("_stratum"),
    )
    return hash_rank(base, ["_stratum"], ["_cluster"], "unit", out="_index", total="_size")


def cluster_draws(clusters: DataFrame, *, cluster: str, n_boot: int, seed: int) -> DataFrame:
    """(boot, cluster, weight): ``n`` draws with replacement out of ``n`` clusters, per stratum when there is one."""
    return draw_table(cluster_multiplicities(clusters, cluster=cluster, n_boot=n_boot, seed=seed), cluster=cluster, n_draws=n_boot)


def cluster_multiplicities(clusters: DataFrame, *, cluster: str, n_boot: int, seed: int | str) -> DataFrame:
    """(cluster, _m): the draws of :func:`cluster_draws`, one byte for each draw; clusters that no draw picked are missing."""
    numbered = durable(_numbered(clusters, cluster).withColumnRenamed("_cluster", cluster))
    return hit_bytes(numbered, key="_stratum", index="_index", size="_size", cluster=cluster, n_draws=n_boot, seed=seed)


def subsample_bytes(clusters: DataFrame, *, cluster: str, n_boot: int, seed: int, share: float = 0.632) -> DataFrame:
    """(cluster, _m): the draws of :func:`cluster_subsamples`, one byte for each draw."""
    lone = durable(clusters.select(cluster).distinct())
    n, keep = lone.agg(F.count(F.lit(1)).alias("n")).select("n", F.bround(F.col("n") * F.lit(share))).first()
    return kept_bytes(lone, cluster=cluster, n_draws=n_boot, seed=seed, n=n, keep=int(keep))


def cluster_subsamples(clusters: DataFrame, *, cluster: str, n_boot: int, seed: int, share: float = 0.632) -> DataFrame:
    """(boot, cluster, weight = 1): ``round(share · n)`` clusters without replacement per draw."""
    return draw_table(subsample_bytes(clusters, cluster=cluster, n_boot=n_boot, seed=seed, share=share), cluster=cluster, n_draws=n_boot)


def _clusters(df: DataFrame, cluster: str, strata: DataFrame | None) -> DataFrame:
    base = df.select(cluster).distinct()
    return base.join(strata, cluster) if strata is not None else base


def _drawn(statistic, cells: DataFrame, draws: DataFrame, cluster: str, out: str, n_boot: int) -> DataFrame:
    if hasattr(statistic, "score_draws"):
        return statistic.score_draws(cells, draws, cluster, n_boot).select("boot", F.col("value").alias(out))
    table = draw_table(draws, cluster=cluster, n_draws=n_boot) if "_m" in draws.columns else draws
    weighted = cells.join(table.withColumnRenamed("weight", "_draws"), cluster).withColumn("_w", F.col("_w") * F.col("_draws"))
    return statistic.score(weighted, ["boot"]).select("boot", F.col("value").alias(out))


def _point(statistic, cells: DataFrame) -> DataFrame:
    return statistic.score(cells.withColumn("_one", F.lit(0)), ["_one"]).select(F.col("value").alias("point"))


def percentile_summary(values: DataFrame, *, value: str, n_boot: int, ci: float = 0.95, min_valid: float = 0.99, keys: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the surviving draws; suppressed when too many were discarded. At most ``n_boot`` values per key."""
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    g = values.groupBy(*keys).agg(
        F.count(value).alias("n_resamples"), F.percentile(value, F.lit(lo)).alias("_lo"), F.percentile(value, F.lit(hi)).alias("_hi")
    )
    valid = F.col("n_resamples") / F.lit(float(n_boot))
    ok = (F.col("n_resamples") > 0) & (valid >= min_valid)
    return g.select(
        *keys, "n_resamples", (F.lit(n_boot) - F.col("n_resamples")).alias("n_discarded"), (1 - valid).alias("discard_frac"),
        F.when(ok, F.col("_lo")).alias("ci_low"), F.when(ok, F.col("_hi")).alias("ci_high"), (~ok).alias("ci_suppressed"),
    )


def _summary(values: DataFrame, point: DataFrame, value: str, n_boot: int, ci: float, min_valid: float) -> DataFrame:
    return attach_row(point, percentile_summary(values, value=value, n_boot=n_boot, ci=ci, min_valid=min_valid))


def bootstrap_values(df: DataFrame, statistics: dict, *, cluster: str, n_boot: int, seed: int, strata: DataFrame | None = None) -> DataFrame:
    """(metric, boot, value): one draw table scores every statistic."""
    parts = _values(df, statistics, cluster, n_boot, seed, strata)
    return reduce(DataFrame.unionByName, [values for values, _ in parts])


def _values(df: DataFrame, statistics: dict, cluster: str, n_boot: int, seed: int, strata: DataFrame | None) -> list[tuple[DataFrame, DataFrame]]:
    """(metric, boot, value) and (metric, point) of every statistic. What is read many times is checkpointed."""
    numbered = durable(_numbered(_clusters(df, cluster, strata), cluster).withColumnRenamed("_cluster", cluster))
    able = any(hasattr(s, "score_blocks") for s in statistics.values())
    dealt = blocks(numbered, cluster=cluster, n_draws=n_boot, seed=seed) if able else None
    out, draws = [], None
    for name, s in statistics.items():
        metric = F.lit(name).alias("metric")
        scored = s.score_blocks(df, dealt, cluster) if dealt and hasattr(s, "score_blocks") else None
        if scored is not None:
            scored = durable(scored.select(metric, "boot", "value"))
            out.append((scored.where(F.col("boot") != EVERY), scored.where(F.col("boot") == EVERY).select("metric", F.col("value").alias("point"))))
            continue
        if draws is None:
            draws = durable(hit_bytes(numbered, key="_stratum", index="_index", size="_size", cluster=cluster, n_draws=n_boot, seed=seed))
        cells = durable(s.compress(df, cluster))
        out.append((_drawn(s, cells, draws, cluster, "value", n_boot).select(metric, "boot", "value"), _point(s, cells).select(metric, "point")))
    return out


def bootstrap_interval(df: DataFrame, statistics: dict, *, cluster: str, n_boot: int = 1000, seed: int = 0, ci: float = 0.95, min_valid: float = 0.99, strata: DataFrame | None = None) -> DataFrame:
    """One interval row per statistic."""
    values, points = (reduce(DataFrame.unionByName, part) for part in zip(*_values(df, statistics, cluster, n_boot, seed, strata), strict=True))
    return points.join(percentile_summary(values, value="value", n_boot=n_boot, ci=ci, min_valid=min_valid, keys=["metric"]), "metric", "left")


def row_bootstrap(df: DataFrame, statistic, *, row_id: str, stratum: str, n_boot: int = 1000, seed: int = 0, ci: float = 0.95, min_valid: float = 0.99) -> DataFrame:
    """Resample rows inside each stratum; every stratum keeps its size."""
    strata = df.select(row_id, F.col(stratum).cast("string").alias("stratum"))
    draws = cluster_multiplicities(strata, cluster=row_id, n_boot=n_boot, seed=seed)
    cells = durable(statistic.compress(df, row_id))
    return _summary(_drawn(statistic, cells, draws, row_id, "value", n_boot), _point(statistic, cells), "value", n_boot, ci, min_valid)


def subsample_interval(df: DataFrame, statistic, *, cluster: str, n_boot: int = 1000, seed: int = 0, share: float = 0.632, ci: float = 0.95, min_valid: float = 0.99) -> DataFrame:
    draws = subsample_bytes(df, cluster=cluster, n_boot=n_boot, seed=seed, share=share)
    cells = durable(statistic.compress(df, cluster))
    return _summary(_drawn(statistic, cells, draws, cluster, "value", n_boot), _point(statistic, cells), "value", n_boot, ci, min_valid)


def paired_difference(a: DataFrame, b: DataFrame, stat_a, stat_b, *, cluster: str, n_boot: int = 1000, seed: int = 0, ci: float = 0.95, min_valid: float = 0.99, strata: DataFrame | None = None) -> DataFrame:
    """Arm A minus arm B under one draw for both arms."""
    draws = durable(cluster_multiplicities(_clusters(a, cluster, strata), cluster=cluster, n_boot=n_boot, seed=seed))
    return _difference(a, b, stat_a, stat_b, cluster, draws, draws, n_boot, ci, min_valid)


def _difference(a, b, stat_a, stat_b, cluster, draws_a, draws_b, n_boot, ci, min_valid, cluster_b=None) -> DataFrame:
    cb = cluster_b or cluster
    cells_a, cells_b = durable(stat_a.compress(a, cluster)), durable(stat_b.compress(b, cb))
    va = _drawn(stat_a, cells_a, draws_a, cluster, "va", n_boot)
    vb = _drawn(stat_b, cells_b, draws_b, cb, "vb", n_boot)
    values = va.join(vb, "boot").select("boot", (F.col("va") - F.col("vb")).alias("value"))
    pa, pb = _point(stat_a, cells_a).withColumnRenamed("point", "point_a"), _point(stat_b, cells_b).withColumnRenamed("point", "point_b")
    point = attach_row(pa, pb).withColumn("point", F.col("point_a") - F.col("point_b"))
    return _summary(values, point, "value", n_boot, ci, min_valid)


def paired_difference_shared(a: DataFrame, b: DataFrame, stat_a, stat_b, *, cluster: str, **options) -> DataFrame:
    """Paired difference over the clusters that both arms have; the arms may hold different rows."""
    left = a.join(b.select(cluster).distinct(), cluster, "left_semi")
    right = b.join(a.select(cluster).distinct(), cluster, "left_semi")
    return paired_difference(left, right, stat_a, stat_b, cluster=cluster, **options)


def independent_difference(a: DataFrame, b: DataFrame, stat_a, stat_b, *, cluster_a: str, cluster_b: str, n_boot: int = 1000, seed: int = 0, ci: float = 0.95, min_valid: float = 0.99) -> DataFrame:
    """Difference of two data sets, each with draws of its own."""
    da = cluster_multiplicities(_clusters(a, cluster_a, None), cluster=cluster_a, n_boot=n_boot, seed=f"{seed}a")
    db = cluster_multiplicities(_clusters(b, cluster_b, None), cluster=cluster_b, n_boot=n_boot, seed=f"{seed}b")
    return _difference(a, b, stat_a, stat_b, cluster_a, da, db, n_boot, ci, min_valid, cluster_b)


def cross_partition_difference(a: DataFrame, b: DataFrame, stat_a, stat_b, *, coarse: str, fine: str, **options) -> DataFrame:
    """Paired difference with the coarser unit, and the finer unit beside it as a sensitivity."""
    main = paired_difference(a, b, stat_a, stat_b, cluster=coarse, **options).withColumn("unit", F.lit("coarse"))
    return main.unionByName(paired_difference(a, b, stat_a, stat_b, cluster=fine, **options).withColumn("unit", F.lit("fine")))


def pair_arms(a: DataFrame, b: DataFrame, *, row_id: str, label: str, keep: Sequence[str], value: str, fold: str = "fold") -> DataFrame:
    """Rows both arms predicted, with each arm's value and fold; a label disagreement raises."""
    right = b.select(row_id, F.col(label).alias("_lb"), F.col(value).alias(f"{value}_b"), F.col(fold).alias(f"{fold}_b"))
    j = a.select(row_id, label, *keep, F.col(value).alias(f"{value}_a"), F.col(fold).alias(f"{fold}_a")).join(right, row_id)
    same = F.when(F.col(label) == F.col("_lb"), F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("the arms disagree on the label of row "), F.col(row_id).cast("string")))
    )
    return j.withColumn(label, same).drop("_lb")


def difference_verdict(passed: str, low: str, high: str, suppressed: str, threshold: float) -> Column:
    ok, lo, hi = F.col(passed), F.col(low), F.col(high)
    bare = F.coalesce(F.col(suppressed), F.lit(True)) | lo.isNull()
    return (
        F.when(ok.isNull(), "not adjudicated (no point estimate)")
        .when(bare, F.when(ok, "pass, no CI").otherwise("fail, no CI"))
        .when(ok & (lo > 0), "pass, established (CI excludes zero)")
        .when(ok, "pass on point estimate, not distinguishable (CI spans zero)")
        .when(hi >= threshold, "fail, underpowered (CI spans the threshold)")
        .otherwise("fail, established (CI excludes the threshold)")
    )


def equivalence_verdict(passed: str, low: str, high: str, suppressed: str, margin: float) -> Column:
    ok, lo, hi = F.col(passed), F.col(low), F.col(high)
    bare = F.coalesce(F.col(suppressed), F.lit(True)) | lo.isNull()
    inside, outside = (lo > -margin) & (hi < margin), (lo > margin) | (hi < -margin)
    return (
        F.when(ok.isNull(), "not adjudicated (no point estimate)")
        .when(bare, F.when(ok, "pass, no CI").otherwise("fail, no CI"))
        .when(ok & inside, "pass, established (CI within equivalence band)")
        .when(ok, "pass on point estimate, not established (CI exceeds equivalence band)")
        .when(outside, "fail, established (CI outside equivalence band)")
        .otherwise("fail, underpowered (CI overlaps equivalence band)")
    )


def level_verdict(value: str, low: str, high: str, suppressed: str, threshold: float) -> Column:
    v, lo, hi = F.col(value), F.col(low), F.col(high)
    ok = v >= threshold
    bare = F.coalesce(F.col(suppressed), F.lit(True)) | lo.isNull()
    return (
        F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "not adjudicated (no point estimate)")
        .when(bare, F.when(ok, "pass, no CI").otherwise("fail, no CI"))
        .when(ok & (lo > threshold), "pass, established (CI excludes the threshold)")
        .when(ok, "pass on point estimate, not distinguishable (CI covers the threshold)")
        .when(hi >= threshold, "fail, underpowered (CI covers the threshold)")
        .otherwise("fail, established (CI excludes the threshold)")
    )


def labelled_units(df: DataFrame, *, unit: str, label: str, fold: str) -> DataFrame:
    """(unit, fold, label): one row per row id or group; a unit in two folds or with two labels raises."""
    lone = (F.min(fold) == F.max(fold)) & (F.min(label) == F.max(label))
    return df.groupBy(unit).agg(
        F.when(lone, F.min(fold)).otherwise(F.raise_error(F.concat(F.lit("unit in two folds or with two labels: "), F.first(F.col(unit).cast("string")))).cast("int")).alias(fold),
        F.min(label).alias(label),
    )


def permutation_lists(df: DataFrame, *, unit: str, label: str, fold: str, n: int, seed: int) -> DataFrame:
    """(unit, fold, label, labels): the unit's label in each of ``n`` draws that permute labels among the units of a fold."""
    per = labelled_units(df, unit=unit, label=label, fold=fold)
    return shuffled_labels(per, row_id=unit, label=label, n=n, seed=seed, within=fold).withColumnRenamed("_shuffled", "labels")


def permutation_marks(df: DataFrame, *, unit: str, label: str, fold: str, classes: Sequence, n: int, seed: int) -> DataFrame:
    """(unit, fold, label, _hits, _marks): of :func:`permutation_lists`, for each class the number of draws that give it to the unit and the sum of their numbers from 1."""
    per = labelled_units(df, unit=unit, label=label, fold=fold)
    return class_marks(per, row_id=unit, label=label, labels=list(classes), n=n, seed=seed, within=fold)


def permute_within_folds(df: DataFrame, *, unit: str, label: str, fold: str, n: int, seed: int) -> DataFrame:
    """(perm, unit, fold, label): labels shuffled among the units of a fold, one row per unit and draw."""
    lists = permutation_lists(df, unit=unit, label=label, fold=fold, n=n, seed=seed)
    return lists.select(F.posexplode("labels").alias("perm", "_label"), unit, fold).select("perm", unit, fold, F.col("_label").alias(label))


def cluster_shapes(df: DataFrame, *, group: str, cluster: str, fold: str) -> DataFrame:
    """(cluster, fold, size): a cluster in two folds raises."""
    g = df.groupBy(cluster, group).agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi"))
    lone = F.min("_lo") == F.max("_hi")
    return g.groupBy(cluster).agg(
        F.when(lone, F.min("_lo")).otherwise(F.raise_error(F.lit("a cluster spans two folds")).cast("int")).alias(fold), F.count("*").alias("size")
    )


def immovable_clusters(df: DataFrame, *, group: str, cluster: str, fold: str) -> DataFrame:
    """Clusters without a same-size partner in their fold; they keep their labels in every draw."""
    s = cluster_shapes(df, group=group, cluster=cluster, fold=fold)
    return s.join(s.groupBy(fold, "size").agg(F.count("*").alias("_k")).where("_k = 1").drop("_k"), [fold, "size"], "left_semi")


def cluster_swaps(df: DataFrame, *, group: str, cluster: str, fold: str, n: int, seed: int) -> DataFrame:
    """(_target, _donor, draws): in which of ``n`` draws a cluster takes the block of a same-size cluster of its fold."""
    shapes = durable(cluster_shapes(df, group=group, cluster=cluster, fold=fold))
    numbered = durable(hash_rank(shapes, [fold, "size"], [cluster], "base", out="_pos"))
    draws = numbered.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = hash_rank(draws, ["perm", fold, "size"], [cluster], seed, out="_to", salt=[F.col("perm")])
    target = numbered.select(fold, "size", F.col(cluster).alias("_target"), F.col("_pos").alias("_to"))
    swap = moved.select("perm", fold, "size", "_to", F.col(cluster).alias("_donor")).join(target, [fold, "size", "_to"])
    return swap.groupBy("_target", "_donor").agg(F.sort_array(F.collect_list("perm")).alias("draws"))  # at most n numbers


def block_labels(df: DataFrame, swaps: DataFrame, *, group: str, label: str, cluster: str) -> DataFrame:
    """(group, label, ...): each group with the label it gets from every donor of its cluster; other columns of ``swaps`` ride along."""
    one = F.when(F.min(label) == F.max(label), F.min(label)).otherwise(F.raise_error(F.lit("a group has two labels")))
    groups = df.groupBy(cluster, group).agg(one.alias(label))
    member = durable(hash_rank(groups, [cluster], [group], "member", out="_m"))
    to = member.select(F.col(cluster).alias("_target"), "_m", group)
    source = member.select(F.col(cluster).alias("_donor"), "_m", label)
    return to.join(swaps, "_target").join(source, ["_donor", "_m"]).drop("_target", "_donor", "_m")


def permute_cluster_blocks(df: DataFrame, *, group: str, label: str, cluster: str, fold: str, n: int, seed: int) -> DataFrame:
    """(perm, group, label): whole clusters swap their label blocks with same-size clusters of their fold."""
    swaps = cluster_swaps(df, group=group, cluster=cluster, fold=fold, n=n, seed=seed)
    return block_labels(df, swaps, group=group, label=label, cluster=cluster).select(F.explode("draws").alias("perm"), group, label)


def cluster_block_marks(df: DataFrame, *, group: str, label: str, cluster: str, fold: str, n: int, seed: int) -> DataFrame:
    """(group, label, hits, marks): in how many draws of :func:`permute_cluster_blocks` a group gets a label, and the sum of their numbers from 1.

    A draw is counted for a pair of clusters, before their groups meet.
    """
    swaps = cluster_swaps(df, group=group, cluster=cluster, fold=fold, n=n, seed=seed)
    marks = F.aggregate(F.transform("draws", lambda p: p.cast("long") + 1), F.lit(0).cast("long"), lambda a, v: a + v)
    counted = swaps.select("_target", "_donor", F.size("draws").cast("long").alias("hits"), marks.alias("marks"))
    return block_labels(df, counted, group=group, label=label, cluster=cluster).groupBy(group, label).agg(F.sum("hits").alias("hits"), F.sum("marks").alias("marks"))


def permutation_pvalue(observed: DataFrame, nulls: DataFrame, *, observed_col: str, value: str, n: int, alternative: str = "greater") -> DataFrame:
    """(1 + draws at least as extreme) / (1 + draws); undefined draws are dropped and counted."""
    extreme = F.col(value) >= F.col(observed_col) if alternative == "greater" else F.col(value) <= F.col(observed_col)
    j = attach_row(nulls, observed.select(observed_col))
    g = j.agg(
        F.first(observed_col).alias("observed"), F.count(value).alias("n_permutations"), F.count_if(extreme).alias("_e"),
        F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"),
    )
    ok = F.col("observed").isNotNull() & (F.col("n_permutations") > 0)
    return g.select(
        "observed", "n_permutations", (F.lit(n) - F.col("n_permutations")).alias("n_dropped"),
        F.when(ok, (1 + F.col("_e")) / (1 + F.col("n_permutations"))).alias("p_value"),
        F.when(F.col("n_permutations") > 0, 1 / (1 + F.col("n_permutations"))).alias("p_value_resolution"),
        F.when(ok, F.col("_e") == 0).alias("resolution_limited"), "null_mean", "null_std",
    )


def permuted_aurocs(df: DataFrame, *, unit: str, y: str, proba: str, classes: Sequence, fold: str, n: int, seed: int) -> DataFrame:
    """(draw, fold, cls, auroc): one-vs-rest AUROC when labels move between the units of a fold and predictions stay.

    Ranks do not depend on a draw, so a unit is its rank sums and its number of rows; a draw's AUROC follows from their sums over the units that get the class.
    """
    classes = list(classes)
    spots = [F.struct(F.lit(i).alias("cls"), F.get(proba, F.lit(i)).alias("score")) for i in range(len(classes))]
    cells = durable(df.select(unit, fold, F.explode(F.array(*spots)).alias("_e")).select(unit, fold, "_e.*").groupBy(unit, fold, "cls", "score").agg(F.count(F.lit(1)).alias("_w")))
    ranks = durable(rank_table(cells, [fold, "cls"], "score", "_rank", weight="_w"))  # apart, so that the join can split a score that many rows share
    ranked = cells.join(ranks.select(fold, "cls", "score", "_rank"), [fold, "cls", "score"])
    one = lambda i, v: F.sum(F.when(F.col("cls") == i, v).otherwise(F.lit(0.0)))
    sums = ranked.groupBy(unit).agg(*[one(i, F.col("_rank") * F.col("_w")).alias(f"_r{i}") for i in range(len(classes))], one(0, F.col("_w").cast("double")).alias("_n"))
    values = F.array(*[f"_r{i}" for i in range(len(classes))], "_n").alias("_values")
    units = durable(labelled_units(df, unit=unit, label=y, fold=fold).join(sums.select(unit, values), unit))
    k = len(classes)
    totals = units.groupBy(fold).agg(F.sum(F.get("_values", F.lit(k))).alias("_total"))
    drawn = class_sums(units, unit=unit, label=y, within=fold, values="_values", n_values=k + 1, labels=classes, n=n, seed=seed).join(totals, fold)
    at = lambda i, j: F.get("sums", F.lit(i * (k + 1) + j))
    spots = F.array(*[F.struct(F.lit(c).alias("cls"), at(i, i).alias("_r"), at(i, k).alias("_p")) for i, c in enumerate(classes)])
    long = drawn.select("draw", fold, "_total", F.explode(spots).alias("_e")).select("draw", fold, "_total", "_e.*")
    rest = F.col("_total") - F.col("_p")
    auroc = F.when((F.col("_p") > 0) & (rest > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * rest))
    return long.select("draw", fold, "cls", auroc.alias("auroc"))


def auroc_permutation_test(df: DataFrame, *, row_id: str, y: str, proba: str, classes: Sequence, fold: str, n_folds: int, n: int = 1000, seed: int, group: str | None = None, cluster: str | None = None) -> DataFrame:
    """Permutation p-value of the fold-averaged macro AUROC with the predictions held fixed."""
    stat = MacroAuroc(y, proba, tuple(classes), fold, n_folds)
    observed = _point(stat, stat.compress(df, row_id))
    unit = group or row_id
    if cluster:
        drawn = permute_cluster_blocks(df, group=unit, label=y, cluster=cluster, fold=fold, n=n, seed=seed)
        nulls = stat.score_rows(permuted_rows(df, drawn, unit=unit, label=y, classes=classes, proba=proba, keep=[fold]), n)
    else:
        nulls = stat._average(permuted_aurocs(df, unit=unit, y=y, proba=proba, classes=classes, fold=fold, n=n, seed=seed), ["draw"])
    return permutation_pvalue(observed, nulls, observed_col="point", value="value", n=n)


def null_standard_score(obs: DataFrame, nulls: DataFrame, *, observed: str, value: str, expected: int) -> DataFrame:
    """z-score against complete null draws with their sample deviation, or the reason there is none."""
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    g = nulls.agg(
        F.count("*").alias("_rows"), F.count_if(finite).alias("_ok"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")
    )
    g = attach_row(g, obs.select(F.col(observed).alias("observed")))
    reason = (
        F.when(F.col("_rows") != expected, "incomplete_null_draws")
        .when(F.col("observed").isNull() | F.isnan("observed") | (F.col("_rows") < 3) | (F.col("_ok") < F.col("_rows")), "invalid_or_insufficient_null_draws")
        .when(F.col("_s") == 0, "zero_null_draw_spread")
    )
    known = reason.isNull() | (reason == "zero_null_draw_spread")
    return g.select(
        "observed", F.when(reason.isNull(), "available").otherwise("unavailable").alias("state"), reason.alias("reason"),
        F.when(reason.isNull(), (F.col("observed") - F.col("_m")) / F.col("_s")).alias("z_score"),
        F.when(known, F.col("_m")).alias("null_mean"), F.when(known, F.col("_s")).alias("null_draw_std"), F.col("_rows").alias("n_null_draws"),
    )


def shuffled_column(df: DataFrame, *, row_id: str, column: str, seed: int) -> DataFrame:
    """The table with one column's values moved between rows by a seeded permutation."""
    numbered = hash_rank(df, [], [row_id], "base", out="_pos")
    moved = hash_rank(df.select(row_id, F.col(column).alias("_v")), [], [row_id], seed, out="_pos").drop(row_id)
    return numbered.join(moved, "_pos").withColumn(column, F.col("_v")).drop("_pos", "_v")
