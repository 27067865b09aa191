"""Model fits over folds with Spark ML, and linear fits from fold moments.

Scaling, centring and reduction of a fold's training side come from per-fold sums:
one pass serves every fold (training = total minus held-out). Only vectors and
matrices whose size depends on the feature count reach the driver. Independent
folds are submitted from a few driver threads so their jobs overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw_unit
from kinfold.functions.ranking import hash_rank
from kinfold.functions.rows import attach_row
from kinfold.functions.vector_expr import argmax_label, dot
from kinfold.operators.factors import BLOCK_ROWS, group_factors, usable
from kinfold.operators.gram import MAX_DIM, collect_gram, fold_moments, gram_rows, moments, ridge_from_gram
from kinfold.operators.metrics import class_metrics, spearman
from kinfold.operators.networks import Network, Networks, fit_networks
from kinfold.operators.routed_trees import Routed, RoutedTrees, fit_routed
from kinfold.operators.shuffles import shuffled_labels
from kinfold.operators.stacked import NONE, Stacked, fit_stacked
from kinfold.session import durable

_THREADS = 4


def _each(folds: Sequence, run: Callable) -> list:
    with ThreadPoolExecutor(_THREADS) as pool:
        return list(pool.map(run, folds))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _lit(values) -> Column:
    return F.lit(np.asarray(values, dtype="float64"))


# --- estimators -------------------------------------------------------------


@dataclass(frozen=True)
class Logistic:
    """L2 logistic regression with the penalty ``1 / (c · n)`` on already scaled features.

    All folds are fitted together by the stacked solver; called like the other builders it gives the
    Spark ML estimator of one fit, which takes over where groups are held back, rows are repeated or coefficients are too many for the solver.
    """

    c: float = 1.0
    max_iter: int = 200

    def __call__(self, n_rows: int, n_classes: int, width: int):
        return LogisticRegression(
            featuresCol="features", labelCol="target", weightCol="weight", regParam=1.0 / (self.c * max(n_rows, 1)),
            standardization=False, maxIter=self.max_iter, family="multinomial" if n_classes > 2 else "binomial",
        )


def logistic(c: float = 1.0, max_iter: int = 200) -> Logistic:
    return Logistic(c, max_iter)


def forest(trees: int = 50, depth: int = 8, seed: int = 0) -> Callable:
    def build(n_rows: int, n_classes: int, width: int):
        return RandomForestClassifier(featuresCol="features", labelCol="target", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)

    return build


def boosted(rounds: int = 20, depth: int = 4, seed: int = 0) -> Callable:
    """Boosted trees; several classes are fitted one against the rest."""

    def build(n_rows: int, n_classes: int, width: int):
        gbt = GBTClassifier(featuresCol="features", labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
        if n_classes == 2:
            return gbt
        return OneVsRest(classifier=gbt, featuresCol="features", labelCol="target", weightCol="weight", parallelism=_THREADS)

    return build


def perceptron(hidden: Sequence[int] = (32,), max_iter: int = 100, seed: int = 0) -> Callable:
    """A multilayer perceptron. It takes no row weights, so pair it with ``balance='oversample'``."""

    def build(n_rows: int, n_classes: int, width: int):
        return MultilayerPerceptronClassifier(
            featuresCol="features", labelCol="target", layers=[width, *hidden, n_classes], maxIter=max_iter, seed=seed
        )

    return build


# --- folds ------------------------------------------------------------------


@dataclass(frozen=True)
class FoldScaling:
    """Training-side mean and population deviation of every fold."""

    mean: dict
    scale: dict

    def apply(self, vec: str, fold) -> Column:
        centred = F.zip_with(vec, _lit(self.mean[fold]), lambda x, m: x - m)
        return F.zip_with(centred, _lit(self.scale[fold]), lambda x, s: x / s)


def fold_scaling(df: DataFrame, *, vec: str, fold: str, eps: float = 1e-8) -> FoldScaling:
    parts = fold_moments(moments(df, key=fold, vec=vec), key=fold)
    n, s, q = (sum(p[i] for p in parts.values()) for i in range(3))
    mean, scale = {}, {}
    for f, (fn, fs, fq) in parts.items():
        m = (s - fs) / (n - fn)
        mean[f], scale[f] = m, np.sqrt(np.maximum((q - fq) / (n - fn) - m * m, 0.0)) + eps
    return FoldScaling(mean, scale)


@dataclass(frozen=True)
class FoldPCA:
    """Training-side principal axes of every fold."""

    mean: dict
    axes: dict
    values: dict
    shares: DataFrame

    def apply(self, vec: str, fold) -> Column:
        mean, axes = self.mean[fold], self.axes[fold]

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(x.to_numpy()) - mean) @ axes.T)) if len(x) else pd.Series([], dtype=object)

        return project(F.col(vec))


def fold_pca(df: DataFrame, *, vec: str, k: int, fold: str = "fold") -> FoldPCA:
    """Principal axes per fold from one pass of second moments."""
    parts = collect_gram(gram_rows(df, key=fold, vec=vec), key=fold)
    total = sum(parts.values())
    mean, axes, values, rows = {}, {}, {}, []
    for f, g in parts.items():
        t = total - g
        n, m = t[0, 0], t[0, 1:] / t[0, 0]
        w, v = np.linalg.eigh(t[1:, 1:] / n - np.outer(m, m))
        order = np.argsort(w)[::-1][: min(k, len(w), int(n) - 1)]
        mean[f], axes[f], values[f] = m, v[:, order].T, np.maximum(w[order], 0)
        rows += [(int(f), i, float(x / w.sum())) for i, x in enumerate(values[f])]
    shares = df.sparkSession.createDataFrame(rows, "fold int, component int, share double")
    return FoldPCA(mean, axes, values, shares)


def _class_table(df: DataFrame, label: str, fold: str, classes: Sequence) -> dict:
    """Class counts per fold on the driver: folds × declared classes numbers."""
    out: dict = {}
    for f, c, n in df.groupBy(fold, label).agg(F.count("*")).collect():
        if c not in classes:
            raise ValueError(f"undeclared class {c!r}")
        out.setdefault(f, dict.fromkeys(classes, 0))[c] = n
    return out


def _target(label: str, classes: Sequence) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("double") - 1.0


def oversampled(df: DataFrame, *, label: str, counts: dict, row_id: str, seed: int) -> DataFrame:
    """Rows repeated until every class is about as large as the largest; fractions go by a seeded draw."""
    top = max(counts.values())
    rate = F.lit(1.0)
    for c, n in counts.items():
        rate = F.when(F.col(label) == c, F.lit(top / max(n, 1))).otherwise(rate)
    copies = F.floor(rate) + (draw_unit(seed, row_id) < (rate - F.floor(rate))).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_copy")


def _class_index(label: str, classes: Sequence) -> Column:
    """0, 1, ... in the declared order; a value that is not declared raises."""
    known = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int")
    return F.when(known > 0, known - 1).otherwise(F.raise_error(F.concat(F.lit("undeclared class "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int"))


class StackedFolds(list):
    """(fold, model, feature column) of every fold, fitted together; ``fit`` has them all."""

    def __init__(self, fit: Stacked, vec: str) -> None:
        super().__init__((p.fold, LinearModel(fit, i), F.col(vec)) for i, p in enumerate(fit.problems))
        self.fit, self.vec = fit, vec


class JointFolds(list):
    """(fold, model, feature column) of every fold's network or trees; ``fit`` has them all."""

    def __init__(self, fit: Networks | Routed, vec: str) -> None:
        super().__init__((p.fold, JointModel(fit, p.fold), F.col(vec)) for p in fit.problems)
        self.fit, self.vec = fit, vec


@dataclass(frozen=True)
class JointModel:
    """One fold's network or trees with the ``transform`` of a Spark ML model."""

    fit: Networks | Routed
    fold: int

    def transform(self, df: DataFrame) -> DataFrame:
        share = F.get(self.fit.shares(vector_to_array("features"), F.array(F.lit(self.fold))), F.lit(0))
        out = df.withColumn("probability", array_to_vector(share))
        p = vector_to_array("probability")
        return out.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))


@dataclass(frozen=True)
class LinearModel:
    """One problem of a stacked fit with the ``transform`` of a Spark ML model."""

    fit: Stacked
    index: int

    def transform(self, df: DataFrame) -> DataFrame:
        raw = self.fit.decisions(vector_to_array("features"), of=[self.index])
        if self.fit.n_classes == 2:
            d = F.get(raw, F.lit(0))
            both = df.withColumn("rawPrediction", array_to_vector(F.array(-d, d)))
            share = 1.0 / (1.0 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
            out = both.withColumn("probability", array_to_vector(F.array(1.0 - share, share)))
        else:
            e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
            out = df.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))})
        p = vector_to_array("probability")
        return out.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))


def _stackable(estimator: Callable, n_classes: int, width: int, balance: str) -> bool:
    return isinstance(estimator, Logistic) and balance != "oversample" and (1 if n_classes == 2 else n_classes) * (width + 1) <= MAX_DIM + 2


def fit_folds(
    df: DataFrame, estimator: Callable, *, row_id: str, vec: str, label: str, classes: Sequence, fold: str = "fold",
    scale: bool = True, reduce_to: int | None = None, balance: str = "weight", seed: int = 0, held: DataFrame | None = None, group: str | None = None,
):
    """One fitted model per fold: yields (fold, model, feature column).

    ``scale=False`` leaves features as given (a projection made earlier stays the
    last step). ``reduce_to`` fits principal axes on the training side instead of
    scaling. ``balance``: weight, oversample or none. ``held`` lists (fold, group)
    kept out of training; a ``Network`` stops early on them.
    """
    if isinstance(estimator, Network):
        if held is None or group is None or reduce_to or not scale or balance != "weight":
            raise ValueError("a network needs held-back groups, and scales and weighs by itself")
        return JointFolds(fit_networks(df, estimator, row_id=row_id, vec=vec, target=_class_index(label, classes), n_classes=len(classes), fold=fold, held=held, group=group), vec)
    if isinstance(estimator, RoutedTrees):
        if held is not None or reduce_to or balance == "oversample":
            raise ValueError("trees with learned sides take no held-back groups, no reduction and no repeated rows")
        return JointFolds(fit_routed(df, estimator, vec=vec, target=_class_index(label, classes), n_classes=len(classes), fold=fold, balance=balance == "weight"), vec)
    given = len(df.select(vec).first()[0])
    if held is None and _stackable(estimator, len(classes), given, balance):
        basis = fold_pca(df, vec=vec, k=reduce_to, fold=fold) if reduce_to else None
        maps = {(0, f): (basis.mean[f], basis.axes[f]) for f in basis.mean} if basis else None
        fit = fit_stacked(
            df, vec=vec, targets=F.array(_class_index(label, classes)), n_classes=len(classes), folds=F.array(fold), balance=balance == "weight", scale=scale, maps=maps, c=estimator.c
        )
        return StackedFolds(fit, vec)
    counts = _class_table(df, label, fold, classes)
    pca = fold_pca(df, vec=vec, k=reduce_to, fold=fold) if reduce_to else None
    scaling = fold_scaling(df, vec=vec, fold=fold) if scale and not reduce_to else None
    width = reduce_to or given

    def features(f) -> Column:
        if pca:
            return pca.apply(vec, f)
        return scaling.apply(vec, f) if scaling else F.col(vec)

    def run(f):
        train = df.where(F.col(fold) != f)
        if held is not None and group:
            train = train.join(held.where(F.col(fold) == f).select(group), group, "left_anti")
            left = dict(train.groupBy(label).count().collect())
            train_counts = {c: left.get(c, 0) for c in classes}
        else:
            train_counts = {c: sum(v[c] for k, v in counts.items() if k != f) for c in classes}
        empty = [c for c, n in train_counts.items() if n == 0]
        if empty:
            raise ValueError(f"fold {f} has no training row of class {empty}")
        n = sum(train_counts.values())
        weight = F.lit(1.0)
        if balance == "weight":
            for c, k in train_counts.items():
                weight = F.when(F.col(label) == c, F.lit(n / (len(classes) * k))).otherwise(weight)
        if balance == "oversample":
            train = oversampled(train, label=label, counts=train_counts, row_id=row_id, seed=seed)
        ready = train.select(array_to_vector(features(f)).alias("features"), _target(label, classes).alias("target"), weight.alias("weight"))
        return f, estimator(n, len(classes), width).fit(ready), features(f)  # the learners cache what they iterate over

    return _each(sorted(counts), run)


def fit_whole(df: DataFrame, estimator: Callable, *, vec: str, label: str, classes: Sequence):
    """One model of all rows, classes weighted to equal sums."""
    if isinstance(estimator, RoutedTrees):
        return JointModel(fit_routed(df, estimator, vec=vec, target=_class_index(label, classes), n_classes=len(classes)), NONE)
    counts = dict(df.groupBy(label).agg(F.count(F.lit(1))).collect())
    n = sum(counts.values())
    weight = F.lit(1.0)
    for c, k in counts.items():
        weight = F.when(F.col(label) == c, F.lit(n / (len(classes) * k))).otherwise(weight)
    return estimator(n, len(classes), 0).fit(df.select(array_to_vector(F.col(vec)).alias("features"), _target(label, classes).alias("target"), weight.alias("weight")))


def predict(df: DataFrame, fitted, *, fold: str, keep: Sequence[str], classes: Sequence, everywhere: bool = False) -> DataFrame:
    """(keep, fold, proba): each fold's model on its held-out rows."""
    if isinstance(fitted, (StackedFolds, JointFolds)) and not everywhere:
        rows = df.where(F.col(fold).isin([p.fold for p in fitted.fit.problems]))
        return rows.select(*keep, fold, F.get(fitted.fit.shares(F.col(fitted.vec), F.array(fold)), F.lit(0)).alias("proba"))
    out = []
    for f, model, features in fitted:
        rows = df if everywhere else df.where(F.col(fold) == f)
        x = rows.select(*keep, F.lit(f).alias(fold) if everywhere else F.col(fold), array_to_vector(features).alias("features"))
        scored = model.transform(x)
        if "probability" in scored.columns:
            proba = vector_to_array("probability")
        else:
            raw = vector_to_array("rawPrediction")
            odds = F.transform(raw, lambda r: 1.0 / (1.0 + F.exp(-2.0 * r)))
            proba = F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))
        out.append(scored.select(*keep, fold, proba.alias("proba")))
    return _union(out)


def out_of_fold(df: DataFrame, estimator: Callable, *, row_id: str, label: str, classes: Sequence, fold: str = "fold", keep: Sequence[str] = (), **options) -> DataFrame:
    """Out-of-fold predictions: one row per eligible row with label, fold, shares and ``pred``.

    Checkpointed, because scores, intervals and permutations all read it again.
    """
    columns = list(dict.fromkeys([row_id, label, *keep]))
    together = isinstance(estimator, (Network, RoutedTrees)) or isinstance(estimator, Logistic) and options.get("held") is None and options.get("balance") != "oversample"
    if not together:  # every fold's learner reads the rows some times, and each time would join them anew, with its broadcasts
        group = options.get("group")
        df = durable(df.select(*dict.fromkeys([*columns, fold, options["vec"], *([group] if group else [])])))
    fitted = fit_folds(df, estimator, row_id=row_id, label=label, classes=classes, fold=fold, **options)
    scored = predict(df, fitted, fold=fold, keep=columns, classes=classes)
    return durable(scored.withColumn("pred", argmax_label("proba", classes)))


def out_of_folds(df: DataFrame, estimator: Logistic, folds: Sequence[str], *, row_id: str, vec: str, label: str, classes: Sequence, scale: bool = True, balance: str = "weight") -> DataFrame:
    """(row, label, run, fold, proba, pred): out-of-fold predictions under several assignments of folds, fitted together.

    ``folds`` names the columns of the assignments; ``run`` is the place of one among them. A row without a fold in an
    assignment takes no part in it.
    """
    every = F.array(*folds)
    fit = fit_stacked(df, vec=vec, targets=F.array(_class_index(label, classes)), n_classes=len(classes), folds=every, balance=balance == "weight", scale=scale, c=estimator.c)
    scored = df.select(row_id, label, F.posexplode(F.arrays_zip(every.alias("fold"), fit.shares(F.col(vec), every).alias("proba"))).alias("run", "_own"))
    scored = scored.select(row_id, label, "run", "_own.*").where(F.col("fold").isNotNull())
    return durable(scored.withColumn("pred", argmax_label("proba", classes)))


def oof_coverage(predictions: DataFrame, eligible: DataFrame, *, row_id: str) -> DataFrame:
    """Eligible rows, predicted rows, rows without and with several predictions."""
    p = predictions.groupBy(row_id).agg(F.count("*").alias("_k"))
    return eligible.select(row_id).join(p, row_id, "full_outer").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_k").isNull()).alias("n_missing"), F.count_if(F.col("_k") > 1).alias("n_repeated")
    )


def align_proba(df: DataFrame, *, proba: str, given: Sequence, declared: Sequence, missing: str = "zero") -> DataFrame:
    """Shares reordered from a model's classes to the declared order.

    A declared class the model never saw gets zero, or raises with ``missing='error'``;
    a class that is not declared always raises.
    """
    extra = [c for c in given if c not in declared]
    absent = [c for c in declared if c not in given]
    if extra or (absent and missing == "error"):
        raise ValueError(f"classes differ: undeclared {extra}, missing {absent}")
    spots = [F.get(proba, F.lit(list(given).index(c))) if c in given else F.lit(0.0) for c in declared]
    return df.withColumn(proba, F.array(*spots))


# --- directions and clusters -------------------------------------------------


def _unit(w: np.ndarray) -> np.ndarray:
    return w / (np.linalg.norm(w) + 1e-10)


def fit_direction(df: DataFrame, *, vec: str, label: str, classes: Sequence = (0, 1), unscale: bool = True) -> np.ndarray:
    """Unit weight vector of a binary logistic fit on all rows, mapped back through the scaler."""
    fit = fit_stacked(df, vec=vec, targets=F.array(_target(label, classes).cast("int")), balance=False)
    return _unit((fit.coef[0][0, :-1] if unscale else fit.scaled[0][0, :-1]))


def half_directions(df: DataFrame, *, vec: str, label: str, halves: Sequence[str]) -> list[dict]:
    """For every assignment of two halves {half: unit direction fitted on that half}, all together."""
    fit = fit_stacked(df, vec=vec, targets=F.array(F.col(label).cast("int")), folds=F.array(*halves), balance=False)
    out: list[dict] = [{} for _ in halves]
    for p, w in zip(fit.problems, fit.coef, strict=True):
        out[p.assignment][1 - p.fold] = _unit(w[0, :-1])
    return out


def _pair_names(classes: Sequence) -> list[tuple]:
    return [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]


def _pair_targets(label: Column, classes: Sequence) -> list[Column]:
    """For every pair of classes 0 or 1, null for rows of other classes."""
    return [F.when(label == F.lit(a), 0).when(label == F.lit(b), 1) for a, b in _pair_names(classes)]


def pair_directions(df: DataFrame, *, vec: str, label: str, classes: Sequence) -> dict:
    """Unit directions for every pair of classes, fitted together."""
    fit = fit_stacked(df, vec=vec, targets=F.array(*_pair_targets(F.col(label), classes)), balance=False)
    return {f"{a}_vs_{b}": _unit(fit.scaled[i][0, :-1]) for i, (a, b) in enumerate(_pair_names(classes))}


def direction_cosines(df: DataFrame, *, vec: str, label: str, classes: Sequence, reference: np.ndarray | None = None, row_id: str, n_shuffles: int = 50, seed: int = 0) -> DataFrame:
    """(pair, cosine, z_score) between pair directions, against label shuffles.

    The given labels and all shuffles are arms of one stacked fit; a shuffle is a keyed bijection of the row numbers, so none of them moves a row.
    """
    pairs = _pair_names(classes)
    shuffled = shuffled_labels(df.select(row_id, vec, label), row_id=row_id, label=label, n=n_shuffles, seed=seed)
    arms = F.flatten(F.transform(F.concat(F.array(F.col(label)), F.col("_shuffled")), lambda v: F.array(*_pair_targets(v, classes))))
    fit = fit_stacked(shuffled, vec=vec, targets=arms, balance=False)
    w = [_unit(c[0, :-1]) for c in fit.scaled]

    def cosines(of: list) -> list[float]:
        return [float(a @ b) for i, a in enumerate(of) for b in of[i + 1 :]]

    names = [f"{a}_vs_{b}" for a, b in pairs]
    observed = dict(zip([f"{a}|{b}" for i, a in enumerate(names) for b in names[i + 1 :]], cosines(w[: len(pairs)]), strict=True))
    null = [v for i in range(1, n_shuffles + 1) for v in cosines(w[i * len(pairs) : (i + 1) * len(pairs)])]
    mean, sd = (float(np.mean(null)), float(np.std(null, ddof=1))) if len(null) >= 3 else (None, None)
    rows = [(k, v, (v - mean) / sd if sd else None) for k, v in observed.items()]
    if reference is not None:
        rows += [(f"{k}|reference", float(v @ _unit(reference)), None) for k, v in zip(names, w, strict=False)]
    return df.sparkSession.createDataFrame(rows, "pair string, cosine double, z_score double")


def cluster_rows(df: DataFrame, *, vec: str, row_id: str, n_clusters: int = 8, n_components: int = 50, seed: int = 0) -> DataFrame:
    """(row, cluster): k-means on standardised, reduced vectors, fitted on the given rows only."""
    from kinfold.operators.vectors import principal_directions, standardize

    n = df.count()
    k = min(n_clusters, n)
    if k < 2:
        return df.select(row_id, F.lit(0).alias("cluster"))
    scaled = durable(standardize(df.select(row_id, vec), vec=vec, training=F.lit(True)).select(row_id, "scaled"))
    width = min(n_components, n - 1, len(scaled.first()["scaled"]))
    axes, _ = principal_directions(scaled, vec="scaled", k=width)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ axes.T)) if len(x) else pd.Series([], dtype=object)

    ready = scaled.select(row_id, array_to_vector(project("scaled")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(ready)
    return model.transform(ready).select(row_id, F.col("prediction").alias("cluster"))


# --- null-tolerant features ---------------------------------------------------


def null_tolerant_vector(columns: Sequence[str], sentinel: float = -1e9) -> Column:
    """Values with a far-off sentinel for null, followed by the missing flags.

    Spark's trees take no nulls; a split below the data range plays the missing
    branch. The values are not imputed, and scores differ from a native learner's.
    """
    values = [F.coalesce(F.col(c).cast("double"), F.lit(sentinel)) for c in columns]
    flags = [F.col(c).isNull().cast("double") for c in columns]
    return F.array(*values, *flags)


def nullable_vector(columns: Sequence[str]) -> Column:
    """Values as they are, nulls included, for ``RoutedTrees``."""
    return F.array(*[F.col(c).cast("double") for c in columns])


# --- ridge and partial least squares from moments -----------------------------


def _coefficients(spark, rows: list, key: str, kind: str, extra: str = "") -> DataFrame:
    return spark.createDataFrame(rows, f"`{key}` {kind}, {extra} w array<double>, b double")


def _kind(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


def ridge_folds(df: DataFrame, *, vec: str, target: str, fold: str = "fold", alpha: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Held-out ridge predictions of every fold from one pass of moments."""
    parts = collect_gram(gram_rows(df, key=fold, vec=vec, target=target), key=fold)
    total = sum(parts.values())
    rows = []
    for f, g in parts.items():
        w, b = ridge_from_gram(total - g, alpha)
        rows.append((f, w.tolist(), b))
    table = F.broadcast(_coefficients(df.sparkSession, rows, fold, _kind(df, fold)))  # one row per fold
    return df.join(table, fold).select(*keep, fold, target, (dot(vec, "w") + F.col("b")).alias("predicted"))


def regression_report(predictions: DataFrame, *, target: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Spearman, Pearson and AUROC at the median per fold."""
    from kinfold.operators.metrics import auroc_at_median, weighted_correlation

    p = durable(predictions)
    keys = list(keys)
    return (
        spearman(p, keys, x="predicted", y=target)
        .join(weighted_correlation(p, keys, x="predicted", y=target, out="pearson").drop("n"), keys, "left")
        .join(auroc_at_median(p, y=target, score="predicted", keys=keys).select(*keys, "auroc"), keys, "left")
    )


def leave_group_out_ridge(
    df: DataFrame, *, group: str, vec: str, target: str, alpha: float = 1.0, min_rows: int = 5, min_training: int = 10, keep: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Predictions for each group from a fit on all the others: total moments minus the group's.

    Only the total (width squared, on the driver and broadcast, at most ``MAX_DIM`` columns) is a matrix of
    moments. A group's own part is rebuilt in its task from its rows, or from the factor they condense to, so
    a group moves no more than its rows and then its weights. Groups under ``min_rows`` rows, or with fewer than
    ``min_training`` others, have no prediction.
    """
    first = df.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    if first is not None and first[0] > MAX_DIM:
        raise ValueError(f"vectors longer than {MAX_DIM} need a reduced basis first")
    rows = usable(df, key=group, vec=vec, target=target)
    sums = collect_gram(gram_rows(rows.withColumn("_all", F.lit(0)), key="_all", vec=vec, target=target), key="_all")
    shared = df.sparkSession.sparkContext.broadcast(sums.get(0))

    def solve(n: int, r: np.ndarray) -> tuple | None:
        if shared.value[0, 0] - n < min_training:
            return None
        w, b = ridge_from_gram(shared.value - r.T @ r, alpha)
        return w.tolist(), b

    fits = group_factors(rows, key=group, vec=vec, target=target, finish=solve, fields="w array<double>, b double", min_rows=min_rows, block_rows=block_rows)
    return df.join(durable(fits), group).select(*keep, group, target, (dot(vec, "w") + F.col("b")).alias("predicted"))


ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def choose_alpha(df: DataFrame, *, vec: str, target: str, fold: str = "fold", alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(fold, alpha, error, chosen): leave-one-out error of each penalty inside each training side.

    The training moments give one eigenbasis per fold; a single pass over the rows
    then adds up every row's leave-one-out residual for every fold and penalty.
    """
    parts = collect_gram(gram_rows(df, key=fold, vec=vec, target=target), key=fold)
    total = sum(parts.values())
    setup = {}
    for f, g in parts.items():
        t = total - g
        n, d = t[0, 0], len(t) - 2
        mean, ym = t[0, 1 : d + 1] / n, t[0, -1] / n
        c = t[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
        b = t[1 : d + 1, -1] - n * mean * ym
        scale = np.sqrt(np.maximum(np.diag(c) / n, 0)) + 1e-12
        lam, v = np.linalg.eigh(c / np.outer(scale, scale))
        setup[f] = (n, mean, scale, ym, np.maximum(lam, 0), v, v.T @ (b / scale))
    shared = df.sparkSession.sparkContext.broadcast(setup)
    kind = _kind(df, fold)

    def add(batches):
        errors: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, own = np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(), pdf["_f"].to_numpy()
            for f, (n, mean, scale, ym, lam, v, vb) in shared.value.items():
                use = own != f
                z = ((x[use] - mean) / scale) @ v
                for a in alphas:
                    fit = z @ (vb / (lam + a)) + ym
                    lever = 1.0 / n + (z * z) @ (1.0 / (lam + a))
                    r = (y[use] - fit) / np.maximum(1.0 - lever, 1e-9)
                    errors[(f, a)] = errors.get((f, a), 0.0) + float(r @ r)
        yield pd.DataFrame([(f, a, e) for (f, a), e in errors.items()], columns=[fold, "alpha", "error"])

    rows = df.select(F.col(vec).alias("_x"), F.col(target).cast("double").alias("_y"), F.col(fold).alias("_f"))
    sums = rows.mapInPandas(add, f"`{fold}` {kind}, alpha double, error double").groupBy(fold, "alpha").agg(F.sum("error").alias("error"))
    best = sums.groupBy(fold).agg(F.min_by("alpha", F.struct("error", "alpha")).alias("_best"))
    return sums.join(best, fold).select(fold, "alpha", "error", (F.col("alpha") == F.col("_best")).alias("chosen"))


def pls_coefficients(g: np.ndarray, components: Sequence[int]) -> dict:
    """{k: (weights, intercept)} of partial least squares with one target, from ``z zᵀ`` alone."""
    n, d = g[0, 0], len(g) - 2
    mean, ym = g[0, 1 : d + 1] / n, g[0, -1] / n
    c = g[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
    s = g[1 : d + 1, -1] - n * mean * ym
    scale = np.sqrt(np.maximum(np.diag(c) / max(n - 1, 1), 0))
    scale = np.where(scale < 1e-12, 1.0, scale)
    c, s = c / np.outer(scale, scale), s / scale
    loadings, rotations, coef, out = [], [], np.zeros(d), {}
    for k in range(1, min(max(components), d, int(n) - 1) + 1):
        if np.linalg.norm(s) < 1e-12:
            break
        r = s / np.linalg.norm(s)
        for p, q in zip(loadings, rotations):
            r = r - (p @ r) * q
        cr = c @ r
        tt = float(r @ cr)
        if tt <= 1e-12:
            break
        p, y = cr / tt, float(r @ s) / tt
        coef = coef + y * r
        s = s - p * (y * tt)
        loadings.append(p)
        rotations.append(r)
        if k in components:
            w = coef / scale
            out[k] = (w, float(ym - mean @ w))
    return out


def pls_sweep(df: DataFrame, *, vec: str, target: str, fold: str = "fold", components: Sequence[int] = (1, 2, 5, 10, 20, 50), keep: Sequence[str] = ()) -> DataFrame:
    """Held-out predictions for every number of components, from one pass of moments."""
    parts = collect_gram(gram_rows(df, key=fold, vec=vec, target=target), key=fold)
    total = sum(parts.values())
    rows = [(f, k, w.tolist(), b) for f, g in parts.items() for k, (w, b) in pls_coefficients(total - g, components).items()]
    table = F.broadcast(_coefficients(df.sparkSession, rows, fold, _kind(df, fold), "n_components int,"))  # folds × components
    return df.join(table, fold).select(*keep, fold, "n_components", target, (dot(vec, "w") + F.col("b")).alias("predicted"))


def tree_regression(df: DataFrame, *, vec: str, target: str, row_id: str, fold: str = "fold", kind: str = "forest", seed: int = 0) -> DataFrame:
    """Held-out predictions of a forest or boosted regressor."""
    maker = {
        "forest": lambda: RandomForestRegressor(featuresCol="features", labelCol="target", numTrees=30, maxDepth=8, seed=seed),
        "boosted": lambda: GBTRegressor(featuresCol="features", labelCol="target", maxIter=20, maxDepth=4, seed=seed),
    }[kind]
    folds = [r[0] for r in df.select(fold).distinct().collect()]
    x = df.select(row_id, fold, F.col(target).cast("double").alias("target"), array_to_vector(F.col(vec)).alias("features"))

    def run(f):
        model = maker().fit(x.where(F.col(fold) != f))
        return model.transform(x.where(F.col(fold) == f)).select(row_id, fold, F.col("target").alias(target), F.col("prediction").alias("predicted"))

    return durable(_union(_each(folds, run)))


# --- composed fits -------------------------------------------------------------


def cascade(df: DataFrame, *, row_id: str, vec: str, label: str, family: str, classes: tuple[str, str, str], fold: str = "fold", arm: str = "unbalanced", seed: int = 0, n_clusters: int = 8) -> DataFrame:
    """Two-stage shares: first LOF against the rest, then GOF against DN among the rest.

    ``classes`` is (GOF, DN, LOF). Arms: family_matched and size_matched choose the
    first stage's training rows, unbalanced takes them all.
    """
    from kinfold.operators.splits import family_matched_rows, size_matched_rows

    gof, dn, lof = classes
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    scaling = fold_scaling(df, vec=vec, fold=fold)

    def stage(train: DataFrame, f, positive: Column):
        counts = train.groupBy(positive.cast("int").alias("p")).agg(F.count("*").alias("n")).collect()
        n = {r.p: r.n for r in counts}
        if len(n) < 2:
            raise ValueError(f"fold {f} has one class in a training stage")
        total = sum(n.values())
        w = F.when(positive, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))
        ready = train.select(array_to_vector(scaling.apply(vec, f)).alias("features"), positive.cast("double").alias("target"), w.alias("weight"))
        return logistic()(total, 2, 0).fit(ready)

    def run(f):
        train = df.where(F.col(fold) != f)
        first = train
        if arm != "unbalanced":
            groups = cluster_rows(train.where(F.col(label) == lof), vec=vec, row_id=row_id, n_clusters=n_clusters, seed=seed)
            slots = train.join(groups, row_id, "left").select(
                row_id, F.col(family).alias("_family"), (F.col(label) == lof).alias("_pos"), F.coalesce(F.concat(F.lit("k"), F.col("cluster").cast("string")), F.col(label)).alias("_slot")
            )
            slots = durable(slots)
            chosen = family_matched_rows(slots.where("_family IS NOT NULL"), row_id=row_id, family="_family", positive="_pos", slot="_slot", seed=seed)
            if arm == "size_matched":
                chosen = size_matched_rows(slots, chosen, row_id=row_id, positive="_pos", slot="_slot", seed=seed)
            first = train.join(chosen.select(row_id), row_id, "left_semi")
        a = stage(first, f, F.col(label) == lof)
        b = stage(train.where(F.col(label) != lof), f, F.col(label) == gof)
        x = df.where(F.col(fold) == f).select(row_id, label, fold, array_to_vector(scaling.apply(vec, f)).alias("features"))
        pa = F.get(vector_to_array("probability"), F.lit(1))
        x = a.transform(x).select(row_id, label, fold, "features", pa.alias("_pa"))
        x = b.transform(x).withColumn("_pb", F.get(vector_to_array("probability"), F.lit(1)))
        rest = 1.0 - F.col("_pa")
        return x.select(row_id, label, fold, F.array(rest * F.col("_pb"), rest * (1.0 - F.col("_pb")), F.col("_pa")).alias("proba"))

    return durable(_union(_each(folds, run)).withColumns({"pred": argmax_label("proba", classes), "arm": F.lit(arm)}))


def permutation_importance(df: DataFrame, model, *, row_id: str, vec: str, names: Sequence[str], label: str, classes: Sequence, repeats: int = 10, seed: int = 0, top: int = 15) -> DataFrame:
    """Drop in balanced accuracy when one feature's values move between rows.

    One job: each row meets one donor row per repeat, and is scored once per feature
    with that feature taken from the donor.
    """
    base = durable(hash_rank(df.select(row_id, vec, label), [], [row_id], "base", out="_pos"))
    draws = base.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    donor = hash_rank(draws.select("_rep", row_id, F.col(vec).alias("_donor")), ["_rep"], [row_id], seed, out="_pos", salt=[F.col("_rep")]).drop(row_id)
    swapped = draws.join(donor, ["_rep", "_pos"]).select(row_id, label, "_rep", vec, "_donor", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_j"))
    mixed = F.transform(F.arrays_zip(F.col(vec).alias("a"), F.col("_donor").alias("b")), lambda z, i: F.when(i == F.col("_j"), z["b"]).otherwise(z["a"]))
    scored = model.transform(swapped.select(label, "_rep", "_j", array_to_vector(mixed).alias("features")))
    target = _target(label, classes)
    per = class_metrics(scored.withColumn("_t", target), y="_t", pred="prediction", classes=[float(i) for i in range(len(classes))], keys=["_j", "_rep"])
    plain = model.transform(base.select(label, array_to_vector(F.col(vec)).alias("features"))).withColumn("_t", target)
    whole = class_metrics(plain, y="_t", pred="prediction", classes=[float(i) for i in range(len(classes))]).select(F.col("balanced_accuracy").alias("_full"))
    drop = attach_row(per, whole).groupBy("_j").agg(
        F.avg(F.col("_full") - F.col("balanced_accuracy")).alias("importance"), F.stddev_pop(F.col("_full") - F.col("balanced_accuracy")).alias("spread")
    )
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_j") + 1)
    return drop.select(name.alias("feature"), "importance", "spread").orderBy(F.desc("importance"), "feature").limit(top)


def axis_scores(df: DataFrame, *, row_id: str, vec: str, label: str, classes: Sequence, fold: str = "fold", keep: Sequence[str] = ()) -> DataFrame:
    """(row, model fold, side, score): every fold's decision value on its training and held-out rows."""
    fitted = fit_folds(df, logistic(), row_id=row_id, vec=vec, label=label, classes=classes, fold=fold, balance="none")
    if isinstance(fitted, StackedFolds):
        scored = df.select(row_id, fold, *keep, F.explode(F.arrays_zip(F.array(*[F.lit(f) for f, _, _ in fitted]).alias("f"), fitted.fit.decisions(F.col(vec)).alias("axis"))).alias("_m"))
        side = F.when(F.col(fold) == F.col("_m.f"), "test").otherwise("train")
        return durable(scored.select(row_id, F.col("_m.f").alias("model_fold"), side.alias("side"), *keep, F.col("_m.axis").alias("axis")))
    out = []
    for f, model, features in fitted:
        scored = model.transform(df.select(row_id, fold, *keep, array_to_vector(features).alias("features")))
        side = F.when(F.col(fold) == f, "test").otherwise("train")
        out.append(scored.select(row_id, F.lit(f).alias("model_fold"), side.alias("side"), *keep, F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("axis")))
    return durable(_union(out))


def axis_associations(scores: DataFrame, *, features: Sequence[str]) -> DataFrame:
    """(feature, rho, n_folds): mean held-out rank correlation between the axis and each feature."""
    long = scores.where("side = 'test'").unpivot(["model_fold", "axis"], list(features), "feature", "value")
    per = spearman(long, ["feature", "model_fold"], x="axis", y="value")
    return per.groupBy("feature").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_folds"))


def axis_regression(scores: DataFrame, *, features: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """(fold, r2): ridge of the axis on features, fitted on training rows, scored on held-out rows."""
    rows = scores.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features]))
    parts = collect_gram(gram_rows(rows.where("side = 'train'"), key="model_fold", vec="_x", target="axis"), key="model_fold")
    coefs = [(f, *(lambda r: (r[0].tolist(), r[1]))(ridge_from_gram(g, alpha))) for f, g in parts.items()]
    table = F.broadcast(_coefficients(scores.sparkSession, coefs, "model_fold", _kind(scores, "model_fold")))  # one row per fold
    test = rows.where("side = 'test'").join(table, "model_fold").withColumn("_p", dot("_x", "w") + F.col("b"))
    mean = test.groupBy("model_fold").agg(F.avg("axis").alias("_m"))
    e = test.join(mean, "model_fold").groupBy("model_fold").agg(
        F.sum(F.pow(F.col("axis") - F.col("_p"), 2)).alias("_r"), F.sum(F.pow(F.col("axis") - F.col("_m"), 2)).alias("_t")
    )
    return e.select(F.col("model_fold").alias("fold"), F.when(F.col("_t") > 0, 1 - F.col("_r") / F.col("_t")).alias("r2"))


def refit_permutation(df: DataFrame, *, vec: str, label: str, row_id: str, n_folds: int, n: int = 20, seed: int = 0, fold: str = "fold", alternative: str = "greater") -> DataFrame:
    """Permutation p-value of the fold-averaged AUROC with a refit per draw; labels (0, 1) move inside folds.

    The given labels and all draws are arms of one stacked fit.
    """
    from kinfold.operators.resample import BinaryAuroc, permutation_pvalue

    moved = shuffled_labels(df.select(row_id, vec, label, fold), row_id=row_id, label=label, n=n, seed=seed, within=fold)
    arms = F.concat(F.array(F.col(label).cast("int")), F.transform("_shuffled", lambda v: v.cast("int")))
    rows = durable(moved.select(row_id, vec, fold, arms.alias("_arms")))
    fit = fit_stacked(rows, vec=vec, targets=F.col("_arms"), folds=F.array(fold))
    scored = rows.select(row_id, fold, F.posexplode(F.arrays_zip(F.col("_arms").alias("_y"), fit.held_out(F.col(vec), F.col(fold)).alias("_s"))).alias("draw", "_a")).select(row_id, fold, "draw", "_a.*")
    stat = BinaryAuroc("_y", "_s", fold, n_folds)
    scores = durable(stat.score(stat.compress(scored, row_id, keys=["draw"]), ["draw"]))
    observed = scores.where("draw = 0").select(F.col("value").alias("point"))
    return permutation_pvalue(observed, scores.where("draw > 0"), observed_col="point", value="value", n=n, alternative=alternative)
