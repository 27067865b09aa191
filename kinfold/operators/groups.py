"""Group-level features: one row per group, missing stays missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.notation import lookup
from kinfold.functions.rows import attach_row

# Expression-specificity classes as ordinal scores.
SPECIFICITY = {
    "tissue enriched": 0.8,
    "group enriched": 0.7,
    "tissue enhanced": 0.6,
    "low tissue specificity": 0.2,
}


def undirected_degree(edges: DataFrame, *, a: str, b: str) -> DataFrame:
    """Distinct partners of every node, counting an edge from both ends; a self-edge counts the node itself."""
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("partner")).unionByName(
        edges.select(F.col(b).alias("node"), F.col(a).alias("partner"))
    )
    return ends.distinct().groupBy("node").agg(F.count("*").alias("degree"))


def symbol_degree(edges: DataFrame, *, a: str, b: str, id_pattern: str) -> DataFrame:
    """Degrees, or nothing when most node names look like database ids rather than symbols."""
    degree = undirected_degree(edges, a=a, b=b)
    share = degree.agg(F.avg(F.col("node").rlike(id_pattern).cast("int")).alias("_share"))
    return attach_row(degree, share).where(F.col("_share") <= 0.5).drop("_share")


def two_hop_value(
    df: DataFrame, ids: DataFrame, *, id_col: str, symbol: str, value: str, order: str, id_order: str
) -> DataFrame:
    """Value per symbol through an id table: version suffix stripped, first symbol per id, first finite value."""
    bare = F.regexp_replace(id_col, r"\.\d+$", "")
    names = ids.withColumn("_id", bare).groupBy("_id").agg(F.min_by(symbol, id_order).alias(symbol))
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).withColumn("_id", bare)
    return finite.join(names, "_id").groupBy(symbol).agg(
        F.min_by(F.col(value), F.struct(order, value)).alias(value)
    )


def thresholded_log10(x: str | Column, floor: float = 1e-3) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c >= floor, F.log10(c))


def ordinal_score(x: str, scores: Mapping[str, float] = SPECIFICITY) -> Column:
    return lookup(scores, F.lower(F.trim(F.col(x))))


def count_nested(items: str | Column, field: str, wanted: str) -> Column:
    """How many nested items have a field containing ``wanted``."""
    c = F.col(items) if isinstance(items, str) else items
    return F.size(F.filter(c, lambda x: F.lower(x[field]).contains(wanted)))


def assemble_groups(universe: DataFrame, sources: Mapping[str, DataFrame], *, key: str) -> DataFrame:
    """One row per group of the universe with each source's value and its ``_missing`` flag."""
    out = universe
    for name, source in sources.items():
        out = out.join(source.select(key, F.col(source.columns[-1]).alias(name)), key, "left")
    return out.withColumns({f"{name}_missing": F.col(name).isNull().cast("int") for name in sources})


def family_residuals(
    df: DataFrame, *, family: str, values: Sequence[str], singleton_by: str = "members", min_observed: int = 2
) -> DataFrame:
    """Value minus the mean of its family's observed values.

    Null unless at least ``min_observed`` are observed. ``singleton_by='members'``
    flags families of one row; ``'observed'`` flags rows whose family has fewer than
    two observed values and rows without a family. The means come from a partial
    aggregation joined back, not from a window over a family.
    """
    stats = df.where(F.col(family).isNotNull()).groupBy(family).agg(
        F.count("*").alias("_members"),
        *[F.avg(v).alias(f"_avg_{v}") for v in values],
        *[F.count(v).alias(f"_n_{v}") for v in values],
    )
    joined = df.join(stats, family, "left")
    out = {}
    for v in values:
        out[f"{v}_residual"] = F.when(
            F.col(v).isNotNull() & (F.col(f"_n_{v}") >= min_observed), F.col(v) - F.col(f"_avg_{v}")
        )
    joined = joined.withColumns(out)
    joined = joined.withColumns({f"{v}_residual_missing": F.col(f"{v}_residual").isNull().cast("int") for v in values})
    if singleton_by == "members":
        flag = F.coalesce(F.col("_members") == 1, F.lit(False)).cast("int")
    else:
        few = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_n_{v}") < 2, F.lit(True)) for v in values])
        flag = few.cast("int")
    drop = ["_members", *[f"_avg_{v}" for v in values], *[f"_n_{v}" for v in values]]
    return joined.withColumn("family_singleton", flag).drop(*drop)


def numeric_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The columns as nullable doubles; NaN becomes null."""
    def clean(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x).alias(c)

    return df.select(*keys, *[clean(c) for c in columns])


def coverage_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Covered, total and percent per column in one pass; an empty column shows ``covered = 0``."""
    one = df.agg(F.count("*").alias("_t"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["_t"], list(columns), "feature", "covered").select(
        "feature",
        "covered",
        F.col("_t").alias("total"),
        F.when(F.col("_t") > 0, 100.0 * F.col("covered") / F.col("_t")).alias("percent"),
    )


def empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return coverage_by_column(df, columns).where("covered = 0").select("feature")


def attach_group_features(df: DataFrame, features: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """Each row with its group's features; a group without a record gets nulls and a flag, never zeros."""
    f = features.select(key, *columns, F.lit(1).alias("_known"))
    return df.join(f, key, "left").withColumn("features_missing", F.col("_known").isNull().cast("int")).drop("_known")


def drop_feature_class(columns: Sequence[str], bases: Sequence[str]) -> list[str]:
    """Column names without the named features and everything derived from them."""
    return [c for c in columns if not any(c == b or c.startswith(f"{b}_") for b in bases)]
