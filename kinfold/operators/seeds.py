"""Reducing per-seed results: nothing is reported unless every requested seed contributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.rows import attach_totals


def _each_seed(seeds: Sequence[int]) -> Column:
    """One row per requested seed."""
    return F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed")


def seed_defects(df: DataFrame, *, seeds: Sequence[int], value: str, keys: Sequence[str] = (), status: str | None = None) -> DataFrame:
    """(keys, seed, defect): one row per requested or found seed; a null defect is a usable seed.

    ``df`` has one row per (keys, seed) with a value and, optionally, a status
    (success, failed, skipped, unscorable).
    """
    keys = list(keys)
    found = df.groupBy(*keys, F.col("seed").cast("int").alias("seed")).agg(
        F.count("*").alias("_n"), F.first(F.col(value).cast("double")).alias("value"), F.first(F.col(status) if status else F.lit("success")).alias("_status")
    )
    one = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    cells = one.select(*keys, _each_seed(seeds), F.lit(True).alias("_want"))
    j = cells.join(found, [*keys, "seed"], "full_outer")
    bad_value = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    defect = (
        F.when(F.col("_n") > 1, "duplicate_seed")
        .when(F.col("_want").isNull(), "unexpected_seed")
        .when(F.col("_n").isNull(), "missing_seed")
        .when(F.col("_status") == "failed", "failed_seed")
        .when(F.col("_status") == "skipped", "skipped_seed")
        .when(F.col("_status") == "unscorable", "unscorable_seed")
        .when(bad_value, "invalid_value")
    )
    return j.select(*keys, "seed", "value", F.col("_want").isNotNull().alias("requested"), defect.alias("defect"))


_ORDER = ("duplicate_seed", "unexpected_seed", "missing_seed", "failed_seed", "skipped_seed", "unscorable_seed", "invalid_value")


def seed_mean(df: DataFrame, *, seeds: Sequence[int], value: str, keys: Sequence[str] = (), status: str | None = None) -> DataFrame:
    """Mean and sample deviation over seeds per cell, or the first defect in the declared order.

    The deviation needs at least three seeds. The seed lists are as long as the
    request.
    """
    d = seed_defects(df, seeds=seeds, value=value, keys=keys, status=status)
    reason = F.lit(None).cast("string")
    for name in reversed(_ORDER):
        reason = F.when(F.col(f"_d_{name}") > 0, F.lit(name)).otherwise(reason)
    g = d.groupBy(*keys).agg(
        *[F.count_if(F.col("defect") == n).alias(f"_d_{n}") for n in _ORDER],
        F.sort_array(F.collect_list(F.when(F.col("defect").isNull() & F.col("requested"), F.col("seed")))).alias("_good"),
        F.sort_array(F.collect_list(F.when(F.col("defect").isNotNull(), F.col("seed")))).alias("_bad"),
        F.sort_array(F.collect_list(F.when(F.col("defect") == "duplicate_seed", F.col("seed")))).alias("_dup"),
        F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
    ).withColumn("reason", reason)
    ok, twice = F.col("reason").isNull(), F.col("reason") == "duplicate_seed"
    none = F.array().cast("array<int>")
    return g.select(
        *keys,
        F.when(ok, "available").otherwise("unavailable").alias("state"),
        "reason",
        F.when(F.coalesce(twice, F.lit(False)), none).otherwise(F.col("_good")).alias("contributing_seeds"),
        F.when(F.coalesce(twice, F.lit(False)), F.col("_dup")).otherwise(F.col("_bad")).alias("affected_seeds"),
        F.when(ok, F.col("_m")).alias("mean"),
        F.when(ok & F.lit(len(seeds) >= 3), F.col("_s")).alias("spread"),
    )


def seed_vote(df: DataFrame, *, seeds: Sequence[int], value: str, threshold: float, minimum: int, comparison: str = "less_than", keys: Sequence[str] = (), status: str | None = None) -> DataFrame:
    """Whether at least ``minimum`` seeds fall on the asked side of a threshold; null on an incomplete set."""
    if not 1 <= minimum <= len(seeds):
        raise ValueError("minimum must be between one and the number of requested seeds")
    d = seed_defects(df, seeds=seeds, value=value, keys=keys, status=status)
    hit = F.col("value") < threshold if comparison == "less_than" else F.col("value") > threshold
    g = d.groupBy(*keys).agg(F.count("defect").alias("_bad"), F.count_if(hit).alias("_k"))
    ok = F.col("_bad") == 0
    return g.select(
        *keys, F.when(ok, "available").otherwise("unavailable").alias("state"), F.when(ok, F.col("_k")).alias("n_supporting"), F.when(ok, F.col("_k") >= minimum).alias("decision")
    )


def paired_seed_difference(a: DataFrame, b: DataFrame, *, seeds: Sequence[int], value: str, keys: Sequence[str] = (), status: str | None = None) -> DataFrame:
    """Arm A minus arm B within each seed, then the seed reducer. A seed either arm lacks is a defect."""
    da = seed_defects(a, seeds=seeds, value=value, keys=keys, status=status)
    db = seed_defects(b, seeds=seeds, value=value, keys=keys, status=status)
    on = [*keys, "seed"]
    j = da.alias("a").join(db.select(*on, F.col("value").alias("_vb"), F.col("defect").alias("_db"), F.col("requested").alias("_rb")), on, "full_outer")
    d = j.select(
        *on,
        F.when(F.col("defect").isNull() & F.col("_db").isNull(), F.col("value") - F.col("_vb")).alias("value"),
        F.coalesce("defect", "_db").alias("defect"),
    )
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(_ORDER) for x in (n, i)])
    g = d.groupBy(*keys).agg(
        F.min(F.element_at(rank, F.col("defect"))).alias("_worst"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("value").alias("n_seeds")
    )
    ok = F.col("_worst").isNull()
    names = F.array(*[F.lit(n) for n in _ORDER])
    return g.select(
        *keys, F.when(ok, "available").otherwise("unavailable").alias("state"), F.get(names, F.col("_worst")).alias("reason"), "n_seeds",
        F.when(ok, F.col("_m")).alias("mean"), F.when(ok & F.lit(len(seeds) >= 3), F.col("_s")).alias("spread"),
    )


def seed_confusion(df: DataFrame, *, seeds: Sequence[int], classes: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, pred, pooled, normalized_mean, state) from long (seed, y, pred, n) counts.

    Unavailable when a requested seed is missing, a class has no support in a seed,
    or a class is not declared.
    """
    keys = list(keys)
    support = df.groupBy(*keys, "seed", "y").agg(F.sum("n").alias("_row"))
    need = support.where((F.col("_row") > 0) & F.col("y").isin(*classes) & F.col("seed").isin(*[int(s) for s in seeds]))
    full = need.groupBy(*keys).agg(F.count("*").alias("_k"))
    odd = df.groupBy(*keys).agg(F.count_if(~F.col("y").isin(*classes) | ~F.col("pred").isin(*classes) | ~F.col("seed").isin(*[int(s) for s in seeds])).alias("_odd"))
    cells = df.join(support, [*keys, "seed", "y"]).groupBy(*keys, "y", "pred").agg(
        F.sum("n").alias("pooled"), (F.sum(F.col("n") / F.nullif("_row", F.lit(0))) / len(seeds)).alias("normalized_mean")
    )
    flags = attach_totals(full, odd, keys).withColumn(
        "state", F.when((F.col("_k") == len(seeds) * len(classes)) & (F.col("_odd") == 0), "available").otherwise("unavailable")
    )
    out = attach_totals(cells, flags, keys)
    ok = F.col("state") == "available"
    return out.select(*keys, "y", "pred", "state", F.when(ok, F.col("pooled")).alias("pooled"), F.when(ok, F.col("normalized_mean")).alias("normalized_mean"))


def prediction_defects(preds: DataFrame, declared: DataFrame, *, seeds: Sequence[int], row_id: str, proba: str, same: Sequence[str]) -> DataFrame:
    """(seed, defect, n): rows a seed lacks, has twice or should not have, metadata that differs, shares that do not sum to one."""
    wanted = declared.select(row_id, *[F.col(c).alias(f"_{c}") for c in same], _each_seed(seeds))
    found = preds.groupBy("seed", row_id).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in same], F.max(F.abs(F.aggregate(proba, F.lit(0.0), lambda a, p: a + p) - 1.0)).alias("_gap")
    )
    j = wanted.withColumn("_want", F.lit(True)).join(found, ["seed", row_id], "full_outer")
    differ = sum([(~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int") for c in same], F.lit(0)) > 0
    defect = (
        F.when(F.col("_want").isNull(), "unexpected_row").when(F.col("_n").isNull(), "missing_row").when(F.col("_n") > 1, "duplicate_row")
        .when(differ, "metadata_mismatch").when(F.col("_gap") > 1e-6, "invalid_shape")
    )
    return j.select("seed", defect.alias("defect")).where("defect IS NOT NULL").groupBy("seed", "defect").agg(F.count("*").alias("n"))


def average_predictions(preds: DataFrame, *, row_id: str, proba: str, n_classes: int, seeds: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Mean shares over seeds per row; null when a seed is missing."""
    g = preds.where(F.col("seed").isin(*[int(s) for s in seeds])).groupBy(row_id, *keep).agg(
        F.count_distinct("seed").alias("_k"), *[F.avg(F.get(proba, F.lit(i))).alias(f"_p{i}") for i in range(n_classes)]
    )
    return g.select(row_id, *keep, F.when(F.col("_k") == len(seeds), F.array(*[F.col(f"_p{i}") for i in range(n_classes)])).alias(proba))


def read_cell(table: DataFrame, *, inference: bool = False) -> DataFrame:
    """Cells that may be quoted: complete ones, with a deviation when used for inference."""
    out = table.where("state = 'available'")
    return out.where(F.col("spread").isNotNull()) if inference else out


def permutation_vote(df: DataFrame, *, seeds: Sequence[int], p_value: str, alpha: float = 0.05, minimum: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Whether enough seeds have a p-value below ``alpha``."""
    return seed_vote(df, seeds=seeds, value=p_value, threshold=alpha, minimum=minimum, comparison="less_than", keys=keys)
