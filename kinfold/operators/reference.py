"""Predictors that look at no feature: what a score has to beat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw_unit
from kinfold.functions.rows import attach_totals
from kinfold.functions.vector_expr import argmax_label
from kinfold.operators.metrics import class_metrics


def training_counts(df: DataFrame, *, label: str, fold: str = "fold", classes: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, c0…): class counts of the rows outside each fold, as total minus own."""
    own = df.groupBy(*keys, fold).agg(*[F.count_if(F.col(label) == c).alias(f"_o{i}") for i, c in enumerate(classes)])
    total = own.groupBy(*keys).agg(*[F.sum(f"_o{i}").alias(f"_t{i}") for i in range(len(classes))])
    joined = attach_totals(own, total, keys)
    return joined.select(*keys, fold, *[(F.col(f"_t{i}") - F.col(f"_o{i}")).alias(f"c{i}") for i in range(len(classes))])


def _majority(classes: Sequence, strict: bool = True):
    counts = [F.col(f"c{i}") for i in range(len(classes))]
    top = F.greatest(*counts)
    tied = sum([(c == top).cast("int") for c in counts], F.lit(0)) > 1
    label = argmax_label(F.array(*counts), classes)
    if not strict:
        return label
    return F.when(tied, F.raise_error(F.lit("the training majority is tied")).cast(_kind(classes))).otherwise(label)


def _kind(classes: Sequence) -> str:
    return "string" if isinstance(classes[0], str) else "int"


def _shares(classes: Sequence):
    total = sum([F.col(f"c{i}") for i in range(1, len(classes))], F.col("c0"))
    return F.array(*[F.col(f"c{i}") / total for i in range(len(classes))])


def majority_reference(df: DataFrame, *, label: str, classes: Sequence, fold: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """Rows with the training majority as ``pred`` and the training class shares as ``proba``; a tie raises."""
    counts = training_counts(df, label=label, fold=fold, classes=classes, keys=keys)
    table = counts.select(*keys, fold, _majority(classes).alias("pred"), _shares(classes).alias("proba"))
    return df.join(table, [*keys, fold])


def stratified_reference(df: DataFrame, *, row_id: str, label: str, classes: Sequence, seed: int, fold: str = "fold") -> DataFrame:
    """Rows with a seeded draw from the training class shares."""
    counts = training_counts(df, label=label, fold=fold, classes=classes).select(fold, _shares(classes).alias("proba"))
    u = draw_unit(seed, row_id)
    pred = F.lit(classes[-1])
    running = [sum([F.get("proba", F.lit(j)) for j in range(1, i + 1)], F.get("proba", F.lit(0))) for i in range(len(classes) - 1)]
    for i in reversed(range(len(classes) - 1)):
        pred = F.when(u < running[i], F.lit(classes[i])).otherwise(pred)
    return df.join(counts, fold).withColumn("pred", pred)


def family_frequency_reference(df: DataFrame, *, label: str, family: str, classes: Sequence, fold: str = "fold", strict: bool = True) -> DataFrame:
    """Rows with the training class shares of their family, or of all training rows when the family is unseen."""
    overall = training_counts(df, label=label, fold=fold, classes=classes)
    own = df.where(F.col(family).isNotNull()).groupBy(family, fold).agg(*[F.count_if(F.col(label) == c).alias(f"_o{i}") for i, c in enumerate(classes)])
    total = own.groupBy(family).agg(*[F.sum(f"_o{i}").alias(f"_t{i}") for i in range(len(classes))])
    k = range(len(classes))
    # every (family, fold) that has test rows; its training counts are the family's other folds
    fam = own.join(total, family).select(family, fold, *[(F.col(f"_t{i}") - F.col(f"_o{i}")).alias(f"f{i}") for i in k])
    seen = sum([F.coalesce(F.col(f"f{i}"), F.lit(0)) for i in k], F.lit(0)) > 0
    joined = df.join(overall, fold).join(fam, [family, fold], "left")
    joined = joined.withColumns({f"c{i}": F.when(seen, F.col(f"f{i}")).otherwise(F.col(f"c{i}")) for i in k})
    drop = [f"f{i}" for i in k] + [f"c{i}" for i in k]
    return joined.withColumns({"pred": _majority(classes, strict), "proba": _shares(classes), "family_seen": seen}).drop(*drop)


def floor_by_fold(df: DataFrame, *, label: str, classes: Sequence, fold: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """Macro-F1 of the majority reference per fold, from counts alone (no row is joined)."""
    counts = training_counts(df, label=label, fold=fold, classes=classes, keys=keys).select(*keys, fold, _majority(classes).alias("pred"))
    cells = df.groupBy(*keys, fold, label).agg(F.count("*").alias("_n"))
    return class_metrics(cells.join(counts, [*keys, fold]), y=label, pred="pred", classes=classes, keys=[*keys, fold], weight="_n")
