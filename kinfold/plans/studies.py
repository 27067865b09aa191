"""Studies composed from the operators. Each returns plain result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.rows import attach_row
from kinfold.functions.vector_expr import dot, norm
from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators import reference as R
from kinfold.operators import resample as S
from kinfold.operators import splits as P
from kinfold.operators.gram import vector_sum
from kinfold.operators.groups import drop_feature_class
from kinfold.operators.routed_trees import RoutedTrees
from kinfold.operators.seeds import paired_seed_difference, seed_mean
from kinfold.operators.vectors import orthonormal, project_out, standardize
from kinfold.session import durable


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def score_arm(df: DataFrame, *, row_id: str, vec: str, label: str, classes: Sequence, estimator: Callable, n_folds: int, **options) -> DataFrame:
    """(fold, macro_f1, macro_auroc, …) of one arm over a ``fold`` column."""
    oof = L.out_of_fold(df, estimator, row_id=row_id, vec=vec, label=label, classes=classes, **options)
    return M.class_metrics(oof, y=label, pred="pred", classes=classes, keys=["fold"]).select("fold", "n", "macro_f1", "balanced_accuracy").join(
        M.macro_auroc(oof, y=label, proba="proba", classes=classes, keys=["fold"]), "fold"
    )


def score_grid(
    df: DataFrame, arms: Mapping[str, str], schemes: Mapping[str, str], *, row_id: str, label: str, classes: Sequence,
    seeds: Sequence[int] = (0,), n_folds: int = 5, estimator: Callable | None = None, options: Mapping[str, dict] | None = None,
) -> DataFrame:
    """(arm, scheme, seed, fold, metrics): every feature arm under every group-disjoint scheme.

    ``arms`` maps a name to a vector column, ``schemes`` a name to the unit held
    out. Rows without a unit take no part in that scheme. A logistic arm is fitted under all schemes and seeds together.
    """
    out = []
    options = options or {}
    runs = [(scheme, unit, seed) for scheme, unit in schemes.items() for seed in seeds]
    linear = {arm: vec for arm, vec in arms.items() if isinstance(options.get(arm, {}).get("estimator") or estimator or L.logistic(), L.Logistic) and set(options.get(arm, {})) <= {"estimator", "scale", "balance"}}
    if linear:
        names = [f"_fold_{i}" for i in range(len(runs))]
        base = rows = durable(df.select(row_id, label, *{u for _, u, _ in runs}, *{v: None for v in linear.values()}))
        for name, (_, unit, seed) in zip(names, runs, strict=True):
            rows = rows.join(durable(P.group_folds(base, unit, n_folds, seed)).withColumnRenamed("fold", name), unit, "left")
        rows = durable(rows)
        for arm, vec in linear.items():
            extra = {k: v for k, v in options.get(arm, {}).items() if k != "estimator"}
            oof = L.out_of_folds(rows, options.get(arm, {}).get("estimator") or estimator or L.logistic(), names, row_id=row_id, vec=vec, label=label, classes=classes, **extra)
            scores = M.class_metrics(oof, y=label, pred="pred", classes=classes, keys=["run", "fold"]).select("run", "fold", "n", "macro_f1", "balanced_accuracy").join(
                M.macro_auroc(oof, y=label, proba="proba", classes=classes, keys=["run", "fold"]), ["run", "fold"]
            )
            told = df.sparkSession.createDataFrame([(i, s, d) for i, (s, _, d) in enumerate(runs)], "run int, scheme string, seed int")
            out.append(scores.join(F.broadcast(told), "run").drop("run").withColumn("arm", F.lit(arm)))  # one row per scheme and seed
    for scheme, unit, seed in runs:
        rest = {arm: vec for arm, vec in arms.items() if arm not in linear}
        if rest:
            folded = durable(P.assign_group_folds(df, group=unit, n_folds=n_folds, seed=seed))
            for arm, vec in rest.items():
                extra = options.get(arm, {})
                s = score_arm(
                    folded, row_id=row_id, vec=vec, label=label, classes=classes, estimator=extra.get("estimator") or estimator or L.logistic(),
                    n_folds=n_folds, **{k: v for k, v in extra.items() if k != "estimator"},
                )
                out.append(s.withColumns({"arm": F.lit(arm), "scheme": F.lit(scheme), "seed": F.lit(seed)}))
    return durable(_union(out))


def seed_scores(grid: DataFrame, *, n_folds: int, metric: str = "macro_f1") -> DataFrame:
    """(arm, scheme, seed, value): the fold mean, null unless every fold contributed."""
    g = grid.groupBy("arm", "scheme", "seed").agg(F.avg(metric).alias("_m"), F.count(metric).alias("_k"))
    return g.select("arm", "scheme", "seed", F.when(F.col("_k") == n_folds, F.col("_m")).alias("value"))


def split_gap(grid: DataFrame, *, seeds: Sequence[int], n_folds: int, metric: str = "macro_f1", first: str = "group", second: str = "family") -> DataFrame:
    """Per arm: score under both schemes and the within-seed gap, reduced over seeds."""
    s = seed_scores(grid, n_folds=n_folds, metric=metric)
    a, b = s.where(F.col("scheme") == first).drop("scheme"), s.where(F.col("scheme") == second).drop("scheme")
    gap = paired_seed_difference(a, b, seeds=seeds, value="value", keys=["arm"])
    ma = seed_mean(a, seeds=seeds, value="value", keys=["arm"]).select("arm", F.col("mean").alias(first))
    mb = seed_mean(b, seeds=seeds, value="value", keys=["arm"]).select("arm", F.col("mean").alias(second))
    return gap.select("arm", "state", F.col("mean").alias("gap"), F.col("spread").alias("gap_spread")).join(ma, "arm").join(mb, "arm")


def leakage_fraction(scores: DataFrame, *, seeds: Sequence[int], keys: Sequence[str] = (), floor: float = 0.02) -> DataFrame:
    """(group − family) / (group − chance) per seed, then over seeds.

    ``scores`` holds (keys, seed, group, family, chance). Null where the group score
    is not more than ``floor`` above chance.
    """
    room = F.col("group") - F.col("chance")
    per = scores.withColumn("value", F.when(room > floor, (F.col("group") - F.col("family")) / room))
    return seed_mean(per, seeds=seeds, value="value", keys=keys).select(
        *keys, "state", "reason", F.col("mean").alias("leakage"), F.col("spread").alias("leakage_spread")
    )


def leakage_scores(group_arm: DataFrame, family_arm: DataFrame, *, row_id: str, label: str, classes: Sequence, keys: Sequence[str] = ("seed",)) -> DataFrame:
    """(keys, group, family, chance) over the rows both arms predicted; chance is the group split's majority floor."""
    keys = list(keys)
    same = group_arm.select(*keys, row_id).join(family_arm.select(*keys, row_id), [*keys, row_id])

    def mean_f1(rows: DataFrame, name: str) -> DataFrame:
        per = M.class_metrics(rows, y=label, pred="pred", classes=classes, keys=[*keys, "fold"])
        return per.groupBy(*keys).agg(F.avg("macro_f1").alias(name))

    a = group_arm.join(same, [*keys, row_id], "left_semi")
    b = family_arm.join(same, [*keys, row_id], "left_semi")
    chance = R.floor_by_fold(a, label=label, classes=classes, keys=keys).groupBy(*keys).agg(F.avg("macro_f1").alias("chance"))
    return mean_f1(a, "group").join(mean_f1(b, "family"), keys).join(chance, keys)


def panel_means(panel: DataFrame, *, value: str, weight: str) -> DataFrame:
    """Plain and weighted mean of a study value over partitions that have one."""
    ok = panel.where(F.col(value).isNotNull())
    return ok.agg(
        F.count("*").alias("n_partitions"), F.avg(value).alias("plain_mean"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean")
    )


def _flat(matrix: np.ndarray) -> list:
    return np.asarray(matrix, dtype="float64").ravel().tolist()


def family_fits(df: DataFrame, *, family: str, fold: str, vec: str, y: str, n_folds: int, steps: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """(family, fits, converged): balanced L2 logistic fits of every fold of every family, by Newton steps over all rows at once.

    A step joins each row with its family's state, adds up gradients and Hessians inside the
    tasks and then by family, and solves each family's small systems; a family of any
    size goes the same way and its rows never meet in one task. ``fits`` holds, for each fold, the means, scales,
    class weights and coefficients, the intercept last; coefficients are NaN where a training side lacks a class.
    A step that raises a fold's loss is halved until it does not. ``converged`` is false where some fold still
    moved by ``tolerance`` or more after ``steps`` passes.
    """
    d = len(df.select(vec).first()[0])
    k, width = n_folds, 3 * d + 3  # mean, scale, two weights, coefficients with intercept
    kind = dict(df.dtypes)[family]
    rows = df.select(F.col(family).alias("_g"), F.col(fold).alias("_f"), F.col(vec).alias("_x"), F.col(y).cast("double").alias("_y"))

    def sums(per_row, size: int, frame: DataFrame) -> DataFrame:
        """Adds a vector of ``size`` numbers for each family; ``per_row(x, y, fold, state)`` gives a part's sum."""

        def add(batches):
            held: dict = {}
            for pdf in batches:
                for g, part in pdf.groupby("_g", sort=False):
                    state = np.array(part["fits"].iloc[0]).reshape(k, width) if "fits" in part else None
                    got = per_row(np.stack(part["_x"].to_numpy()), part["_y"].to_numpy(), part["_f"].to_numpy(), state)
                    held[g] = held[g] + got if g in held else got
                if len(held) * size * 8 > 64 << 20:
                    yield pd.DataFrame({"_g": list(held), "part": [v.tolist() for v in held.values()]})
                    held = {}
            yield pd.DataFrame({"_g": list(held), "part": [v.tolist() for v in held.values()]})

        parts = frame.mapInPandas(add, f"_g {kind}, part array<double>")
        return parts.groupBy("_g").agg(vector_sum("part").alias("sums"))

    def moments(x, t, f, _):
        one = np.stack([np.concatenate([[(f == i).sum(), t[f == i].sum()], x[f == i].sum(0), (x[f == i] ** 2).sum(0)]) for i in range(k)])
        return one.ravel()

    def start(batches):
        for pdf in batches:
            fits = []
            for flat in pdf["sums"]:
                own = np.array(flat).reshape(k, -1)
                train = own.sum(0) - own
                out = np.full((k, width), np.nan)
                for i, (n, pos, *rest) in enumerate(train):
                    if 0 < pos < n:
                        mean = np.array(rest[:d]) / n
                        scale = np.sqrt(np.maximum(np.array(rest[d:]) / n - mean**2, 0)) + 1e-8
                        out[i] = np.concatenate([mean, scale, [0.5 * n / (n - pos), 0.5 * n / pos], np.zeros(d + 1)])
                fits.append(_flat(out))
            yield pd.DataFrame({"_g": pdf["_g"], "fits": fits, "back": [[]] * len(pdf), "moved": np.inf})

    def curvature(x, t, f, state):
        out, loss = np.zeros((k, d + 1, d + 2)), np.zeros(k)
        for i in range(k):
            use = f != i
            if np.isnan(state[i, 0]) or not use.any():
                continue
            z = np.hstack([(x[use] - state[i, :d]) / state[i, d : 2 * d], np.ones((use.sum(), 1))])
            w = np.where(t[use] == 1, state[i, 2 * d + 1], state[i, 2 * d])
            eta = z @ state[i, 2 * d + 2 :]
            p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            loss[i] = w @ np.logaddexp(0, np.where(t[use] == 1, -eta, eta))
            out[i, :, 0] = z.T @ (w * (p - t[use]))
            out[i, :, 1:] = (z * (w * p * (1 - p))[:, None]).T @ z
        return np.concatenate([loss, out.ravel()])

    def step(batches):
        ridge = np.eye(d + 1)
        ridge[-1, -1] = 1e-8
        for pdf in batches:
            fits, back, moved = [], [], []
            for flat, old, added in zip(pdf["fits"], pdf["back"], pdf["sums"], strict=True):
                state, loss, add = np.array(flat).reshape(k, width), np.array(added[:k]), np.array(added[k:]).reshape(k, d + 1, d + 2)
                prior = np.array(old).reshape(k, d + 2) if len(old) else np.full((k, d + 2), np.inf)  # coefficients and their loss
                most = 0.0
                for i in range(k):
                    if not np.isnan(state[i, 0]):
                        now_b, was = state[i, 2 * d + 2 :].copy(), prior[i, :-1]
                        total = loss[i] + now_b @ ridge @ now_b / 2
                        if total > prior[i, -1] + 1e-10 * abs(prior[i, -1]):
                            change = (now_b - was) / 2
                        else:
                            change = np.linalg.solve(add[i, :, 1:] + ridge, add[i, :, 0] + ridge @ now_b)
                            prior[i] = np.append(now_b, total)
                        state[i, 2 * d + 2 :] = now_b - change
                        most = max(most, float(np.abs(change).max()))
                fits.append(_flat(state))
                back.append(_flat(prior))
                moved.append(most)
            yield pd.DataFrame({"_g": pdf["_g"], "fits": fits, "back": back, "moved": moved})

    shape = f"_g {kind}, fits array<double>, back array<double>, moved double"
    now = durable(sums(moments, k * (2 * d + 2), rows).mapInPandas(start, shape))
    for _ in range(steps):
        added = sums(curvature, k * (d + 1) * (d + 2) + k, rows.join(now.select("_g", "fits"), "_g"))
        now = durable(now.select("_g", "fits", "back").join(added, "_g").mapInPandas(step, shape))
        if (now.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return now.select(F.col("_g").alias(family), "fits", (F.col("moved") < tolerance).alias("converged"))


def within_family_scores(df: DataFrame, *, row_id: str, vec: str, y: str, family: str, gene: str, min_genes: int = 8, n_folds: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(qualifying families, their held-out rows: row, family, gene, fold, y, score, converged), genes disjoint between the folds of a family."""
    chosen = durable(P.select_families(df, family=family, gene=gene, label=y, min_genes=min_genes, min_classes=2))
    genes = df.join(chosen.select(family), family, "left_semi").select(family, gene).distinct()
    dealt = P.stratified_folds(genes, row_id=gene, stratum=family, n_folds=n_folds, seed=seed, min_size=n_folds)
    rows = durable(df.select(row_id, family, gene, y, vec).join(dealt, [family, gene]))
    if rows.isEmpty():
        return chosen, rows.select(row_id, family, gene, "fold", y, F.lit(None).cast("double").alias("score"), F.lit(True).alias("converged"))
    d = len(rows.select(vec).first()[0])
    fits = family_fits(rows, family=family, fold="fold", vec=vec, y=y, n_folds=n_folds)
    own = F.slice("fits", F.col("fold") * (3 * d + 3) + 1, 3 * d + 3)
    part = lambda a, n: F.slice("_fit", a + 1, n)
    z = F.zip_with(F.zip_with(vec, part(0, d), lambda v, m: v - m), part(d, d), lambda v, s: v / s)
    scored = rows.join(fits, family).withColumn("_fit", own).where(~F.isnan(F.get("_fit", F.lit(0)))).withColumn("_z", z)
    score = dot("_z", part(2 * d + 2, d)) + F.get("_fit", F.lit(3 * d + 2))
    return chosen, durable(scored.select(row_id, family, gene, "fold", y, score.alias("score"), "converged"))


def within_family_study(df: DataFrame, *, row_id: str, vec: str, y: str, family: str, gene: str, min_genes: int = 8, n_folds: int = 3, seed: int = 0) -> DataFrame:
    """(family, n, n_genes, auroc, converged): held-out ranking inside each qualifying family, genes disjoint.

    A fold whose training side lacks a class is left out of its family's mean, whatever the family's size.
    """
    chosen, scored = within_family_scores(df, row_id=row_id, vec=vec, y=y, family=family, gene=gene, min_genes=min_genes, n_folds=n_folds, seed=seed)
    auc = M.ranking_metrics(scored, y=y, score="score", keys=[family, "fold"]).groupBy(family).agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("n_folds"))
    done = scored.groupBy(family).agg(F.bool_and("converged").alias("converged"))
    return chosen.join(auc, family, "left").join(done, family, "left").orderBy(F.desc("n_rows"), family)


def pooled_within_family(
    scored: DataFrame, *, family: str, gene: str, fold: str, y: str, score: str, n_folds: int, n_boot: int = 1000, seed: int = 0
) -> DataFrame:
    """One row: AUROC of held-out scores inside every (family, fold), averaged over all of them, with a gene-resampled interval.

    Scores of different fits are never ranked together. Only families with a row of class 1 are pooled; the point is
    null unless each of their ``n_folds`` folds holds both classes. Genes are drawn within strata of equal fold and
    classes, so that rare rows of class 1 stay in the draws. Without such a family all counts are zero and the point is null.
    """
    bearing = scored.groupBy(family).agg(F.max(y).alias("_top")).where("_top = 1").select(family)
    name = lambda *c: F.to_json(F.struct(*[F.col(x).alias(f"_{i}") for i, x in enumerate(c)]))
    rows = durable(
        scored.where(F.col(family).isNotNull()).join(bearing, family, "left_semi").select(
            F.col(family).alias("_family"), name(family, fold).alias("_block"), name(family, gene).alias("_gene"), F.col(y).cast("int").alias("_y"), F.col(score).alias("_s")
        )
    )
    counts = rows.agg(
        F.count_distinct("_family").alias("n_families"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_gene").alias("n_genes"), F.count_if(F.col("_y") == 1).alias("n_positive")
    )
    blocks = counts.first()["n_families"] * n_folds
    if blocks == 0:
        none = F.lit(None).cast("double")
        return counts.select("*", none.alias("point"), F.lit(0).cast("long").alias("n_resamples"), none.alias("ci_low"), none.alias("ci_high"), F.lit(True).alias("ci_suppressed"))
    strata = S.class_presence_strata(rows, cluster="_gene", folds=["_block"], label="_y")
    interval = S.bootstrap_interval(rows, {"auroc": S.BinaryAuroc("_y", "_s", "_block", blocks)}, cluster="_gene", n_boot=n_boot, seed=seed, strata=strata)
    return attach_row(counts, interval.select("point", "n_resamples", "ci_low", "ci_high", "ci_suppressed"))


def magnitude_direction_arms(df: DataFrame, *, vec: str) -> DataFrame:
    """Columns ``full``, ``magnitude_only`` and ``direction_only`` for a vector column."""
    length = norm(vec)
    return df.withColumns(
        {"full": F.col(vec), "magnitude_only": F.array(length), "direction_only": F.transform(vec, lambda x: x / (length + 1e-8)), "magnitude": length}
    )


def direction_ablation(df: DataFrame, *, row_id: str, vec: str, label: str, k_max: int, fold: str = "fold") -> DataFrame:
    """(removed, fold, auroc): refit after removing 0…k directions, each fitted on what was left.

    Projection comes last: features are standardised once before it and never again
    after it, so a removed direction stays removed.
    """
    current = durable(standardize(df.select(row_id, vec, label, fold), vec=vec, training=F.lit(True), constant_scale=1.0).select(row_id, label, fold, F.col("scaled").alias("x")))
    found: list[np.ndarray] = []
    out = []
    for k in range(k_max + 1):
        rows = project_out(current, vec="x", basis=np.array(found), out="x_left").select(row_id, label, fold, F.col("x_left").alias("x")) if found else current
        oof = L.out_of_fold(rows, L.logistic(), row_id=row_id, vec="x", label=label, classes=(0, 1), fold=fold, scale=False)
        auc = M.ranking_metrics(oof.withColumn("p", F.get("proba", F.lit(1))), y=label, score="p", keys=[fold])
        out.append(auc.select(F.lit(k).alias("removed"), fold, "auroc"))
        if k < k_max:
            found.append(L.fit_direction(rows, vec="x", label=label))
            found = list(orthonormal(np.array(found)))
    return _union(out)


def half_transfer(df: DataFrame, *, row_id: str, vec: str, label: str, group: str, n_partitions: int, seed: int = 0, min_per_class: int = 5) -> DataFrame:
    """(partition, train_half, auroc, cosine): fit on one half of the groups, score the other, both ways."""
    halves = durable(P.half_partitions(df, group=group, n_partitions=n_partitions, seed=seed))
    usable = sorted({r.partition for r in P.usable_halves(df, halves, group=group, y=label, min_per_class=min_per_class).collect()})  # two rows per partition
    if not usable:
        return df.sparkSession.createDataFrame([], "partition int, train_half int, auroc double, cosine double")
    names = [f"_half_{p}" for p in usable]
    dealt = halves.groupBy(group).agg(*[F.max(F.when(F.col("partition") == p, F.col("half"))).cast("int").alias(n) for p, n in zip(usable, names, strict=True)])
    rows = durable(df.select(row_id, vec, label, group).join(dealt, group))
    oof = L.out_of_folds(rows, L.logistic(), names, row_id=row_id, vec=vec, label=label, classes=(0, 1))
    auc = M.ranking_metrics(oof.withColumn("p", F.get("proba", F.lit(1))), y=label, score="p", keys=["run", "fold"])
    cosines = [(i, p, float(w[0] @ w[1])) for i, (p, w) in enumerate(zip(usable, L.half_directions(rows, vec=vec, label=label, halves=names), strict=True))]
    told = df.sparkSession.createDataFrame(cosines, "run int, partition int, cosine double")
    return auc.join(F.broadcast(told), "run").select("partition", (1 - F.col("fold")).cast("int").alias("train_half"), "auroc", "cosine")  # one row per partition


def paired_arm_contrast(df: DataFrame, vec_a: str, vec_b: str, *, row_id: str, label: str, group: str, n_folds: int, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """AUROC of two feature sets on the same folds and their paired cluster-bootstrap difference."""
    def arm(vec: str) -> DataFrame:
        oof = L.out_of_fold(df, L.logistic(), row_id=row_id, vec=vec, label=label, classes=(0, 1), keep=[group])
        return oof.select(row_id, label, group, "fold", F.get("proba", F.lit(1)).alias("p"))

    rows = durable(S.pair_arms(arm(vec_a), arm(vec_b), row_id=row_id, label=label, keep=[group], value="p"))
    return S.paired_difference(
        rows, rows, S.BinaryAuroc(label, "p_a", "fold_a", n_folds), S.BinaryAuroc(label, "p_b", "fold_b", n_folds), cluster=group, n_boot=n_boot, seed=seed
    )


def stability_study(
    df: DataFrame, *, row_id: str, vec: str, target: str, domain: str, family: str, n_folds: int = 5, seed: int = 0
) -> DataFrame:
    """(scheme, fold, rho, …): ridge under the random, domain and family schemes."""
    bundle = P.scheme_bundle(df, row_id=row_id, domain=domain, family=family, n_folds=n_folds, seed=seed)
    out = []
    for scheme in ("random", "domain", "family"):
        rows = durable(df.join(bundle.where(F.col("scheme") == scheme).drop("scheme"), row_id))
        p = L.ridge_folds(rows, vec=vec, target=target, keep=[row_id])
        out.append(L.regression_report(p, target=target).withColumn("scheme", F.lit(scheme)))
    return _union(out)


def direction_removal_effect(
    stability: DataFrame, task: DataFrame, *, vec: str, target: str, row_id: str, label: str, group: str, n_folds: int, n_boot: int = 200, seed: int = 0
) -> DataFrame:
    """Score change of a task when the stability direction is removed from its vectors.

    The direction is fitted in the stability set's scaled space, the task's vectors go
    through that same scaler, and nothing is rescaled after the removal.
    """
    from kinfold.operators.vectors import scale_stats, target_direction

    stats = scale_stats(stability, vec=vec).first()  # one row of vector length
    mean, scale = np.array(stats["_mean"]), np.array(stats["_std"]) + 1e-8

    def scaled(df: DataFrame) -> DataFrame:
        z = F.zip_with(F.zip_with(vec, F.lit(mean), lambda x, m: x - m), F.lit(scale), lambda x, s: x / s)
        return df.withColumn("_z", z)

    weights = target_direction(scaled(stability), vec="_z", target=target).orderBy("dim").collect()
    axis = np.array([r.weight for r in weights])
    both = durable(project_out(scaled(task), vec="_z", basis=axis[None, :], out="_left").select(row_id, label, group, "fold", "_z", "_left"))

    def arm(column: str) -> DataFrame:
        oof = L.out_of_fold(both, L.logistic(), row_id=row_id, vec=column, label=label, classes=(0, 1), keep=[group], scale=False)
        return oof.select(row_id, label, group, "fold", F.get("proba", F.lit(1)).alias("p"))

    rows = durable(S.pair_arms(arm("_left"), arm("_z"), row_id=row_id, label=label, keep=[group], value="p"))
    return S.paired_difference(rows, rows, S.BinaryAuroc(label, "p_a", "fold_a", n_folds), S.BinaryAuroc(label, "p_b", "fold_b", n_folds), cluster=group, n_boot=n_boot, seed=seed)


def feature_class_ablation(
    df: DataFrame, columns: Sequence[str], classes_of_features: Mapping[str, Sequence[str]], *, row_id: str, label: str, classes: Sequence,
    estimator: Callable, n_folds: int,
) -> DataFrame:
    """(dropped, score, change): the score with each feature class left out; null when either score is null."""
    def score(cols: Sequence[str], name: str) -> DataFrame:
        rows = df.withColumn("_x", L.nullable_vector(cols) if isinstance(estimator, RoutedTrees) else L.null_tolerant_vector(cols))
        s = score_arm(rows, row_id=row_id, vec="_x", label=label, classes=classes, estimator=estimator, n_folds=n_folds, scale=False)
        g = s.agg(F.avg("macro_f1").alias("_m"), F.count("macro_f1").alias("_k"))
        return g.select(F.lit(name).alias("dropped"), F.when(F.col("_k") == n_folds, F.col("_m")).alias("score"))

    parts = [score(columns, "none")] + [score(drop_feature_class(columns, bases), name) for name, bases in classes_of_features.items()]
    table = durable(_union(parts))
    full = table.where("dropped = 'none'").select(F.col("score").alias("_full"))
    return attach_row(table, full).select("dropped", "score", (F.col("score") - F.col("_full")).alias("change"))


def overlap_regimes(df: DataFrame, flag: Column, *, y: str, score: str, min_rows: int = 100, fold: str | None = None) -> DataFrame:
    """(regime, fold, n, auroc, skip): published scores over all rows, rows inside and outside another model's training set."""
    tagged = df.withColumn("_regimes", F.array(F.lit("ALL"), F.when(flag, "IN").otherwise("OUT"))).withColumn("regime", F.explode("_regimes"))
    keys = ["regime"] + ([fold] if fold else [])
    size = tagged.groupBy("regime").agg(F.count("*").alias("n_regime"))
    auc = M.ranking_metrics(tagged, y=y, score=score, keys=keys)
    small = F.col("n_regime") < min_rows
    return auc.join(size, "regime").select(
        *keys, "n_regime", F.when(~small, F.col("auroc")).alias("auroc"), F.when(small, "too few rows").alias("skip")
    )


def compare_runs(old: DataFrame, new: DataFrame, *, keys: Sequence[str], abs_threshold: float = 0.005) -> DataFrame:
    """(keys, path, state, change, threshold): every leaf of two flattened runs.

    A ``….mean`` leaf moves when it changes by more than the old run's seed deviation
    where that aggregate is available and has one; other numbers by more than
    ``abs_threshold``. Non-numbers change when they differ.
    """
    on = [*keys, "path"]
    num = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*on, F.col("value").alias(f"v{s}"), F.when(num, F.col("value").try_cast("double")).alias(f"n{s}"), F.lit(True).alias(f"in{s}"))

    base = F.regexp_replace("path", r"\.(seed_std|state)$", "")
    agg = old.where(F.col("path").rlike(r"\.(seed_std|state)$")).groupBy(*keys, F.concat(base, F.lit(".mean")).alias("path")).agg(
        F.max(F.when(F.col("path").endswith(".seed_std") & num, F.col("value").try_cast("double"))).alias("_sd"),
        F.max(F.when(F.col("path").endswith(".state"), F.col("value"))).alias("_st"),
    )
    sd = agg.where("_st = 'available' AND _sd > 0").select(*on, "_sd")
    j = side(old, "1").join(side(new, "2"), on, "full_outer").join(sd, on, "left")
    threshold = F.coalesce("_sd", F.lit(abs_threshold))
    both = F.col("n1").isNotNull() & F.col("n2").isNotNull()
    nan1, nan2 = F.isnan("n1"), F.isnan("n2")
    state = (
        F.when(F.col("in1").isNull(), "added")
        .when(F.col("in2").isNull(), "removed")
        .when(both & nan1 & nan2, "unchanged")
        .when(both & (nan1 | nan2), "incomparable")
        .when(both & (F.abs(F.col("n2") - F.col("n1")) > threshold), "moved")
        .when(both, "unchanged")
        .when(F.col("v1").eqNullSafe(F.col("v2")), "unchanged")
        .otherwise("changed")
    )
    return j.select(*on, state.alias("state"), (F.col("n2") - F.col("n1")).alias("change"), F.when(both, threshold).alias("threshold"), (both & F.col("_sd").isNotNull()).alias("used_seed_std"))


def comparison_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("threshold").isNotNull() & ~F.col("used_seed_std")).alias("n_fallback"))


def cohort_accounting(df: DataFrame, *, group: str, label: str, min_rows: int) -> DataFrame:
    """(label, n_before, n_excluded, n_after) of groups by majority label, with a total row.

    A group's label is its most frequent one; the alphabetically first on a tie.
    """
    n = df.groupBy(group, label).agg(F.count("*").alias("_n"))
    g = n.groupBy(group).agg(F.sum("_n").alias("_rows"), F.min_by(label, F.struct((-F.col("_n")).alias("a"), label)).alias(label))
    return g.rollup(label).agg(
        F.count("*").alias("n_before"), F.count_if(F.col("_rows") < min_rows).alias("n_excluded"), F.count_if(F.col("_rows") >= min_rows).alias("n_after")
    )


def family_sizes(df: DataFrame, *, family: str, gene: str) -> DataFrame:
    """(size, n_families): how many families have how many genes; size one is a singleton."""
    f = df.where(F.col(family).isNotNull()).select(family, gene).distinct().groupBy(family).agg(F.count("*").alias("size"))
    return f.groupBy("size").agg(F.count("*").alias("n_families"))

