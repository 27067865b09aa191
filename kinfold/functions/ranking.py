"""Exact ranks, running sums and quantiles that never put one group in one task.

A plain ``row_number().over(partitionBy(k))`` sends every row of a hot key to one
task. Each helper here first cuts a group into ordered buckets by a fixed
monotone function of the sort value, sums the buckets (a table whose size does
not depend on the row count), turns the sums into offsets, and finishes inside
(group, bucket). The answer equals the plain window's.

Keys must not be null: they are join keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.hashing import as_col, draw_hex

STEPS = 4096
#: A group is cut into up to 16 ** 4 buckets of its draws, whatever its size: 10^12 rows without a key are buckets of 1.5 * 10^7.
BUCKET_DIGITS = 4
_SHIFT = 1100.0 * STEPS


def value_bucket(value: str | Column) -> Column:
    """A bucket number that never decreases with ``value``.

    Buckets are logarithmic (4096 per power of two) in ``a / (1 - a)`` below one, so
    that probabilities saturating at zero or one stay spread out, and in ``a`` above.
    """
    given = as_col(value).cast("double")
    x = F.when(F.isnan(given), F.raise_error(F.lit("a value to rank is not a number")).cast("double")).otherwise(given)
    a = F.least(F.abs(x), F.lit(1e290))
    odds = F.when(a < 1.0, a / (1.0 - a)).otherwise(a * 18014398509481984.0)
    level = F.floor(F.log2(F.greatest(odds, F.lit(1e-300))) * STEPS) + _SHIFT
    return (F.signum(x) * level).cast("long")


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def _with_offsets(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Attach, per (keys, bucket), each sum over earlier buckets and over the group."""
    whole = _over(keys)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(n) for n in names])
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
    )
    return df.join(offsets, [*keys, "_bucket"])


def prefix_sums(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column]
) -> DataFrame:
    """One row per (keys, value) with each sum, ``*_before`` (strictly smaller values) and ``*_total``.

    Ties collapse in the first partial aggregation, so a value shared by a third
    of all rows is one row from there on.
    """
    keys, names = list(keys), list(sums)
    grouped = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    joined = _with_offsets(grouped.withColumn("_bucket", value_bucket(value)), keys, names)
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.select(
        *keys,
        value,
        *names,
        *[
            (F.col(f"_off_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
            for n in names
        ],
        *[f"{n}_total" for n in names],
    )


def rank_table(df: DataFrame, keys: Sequence[str], value: str, out: str, weight: str | None = None) -> DataFrame:
    """(keys, value, out, out_total): average 1-based rank of every distinct value and the group's weight.

    A weight counts a row that many times.
    """
    w = F.col(weight) if weight else F.lit(1)
    return prefix_sums(df, keys, value, {"_w": w}).select(
        *keys, value, (F.col("_w_before") + (F.col("_w") + 1) / 2).alias(out), F.col("_w_total").alias(f"{out}_total")
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seed: int | str,
    out: str = "rank",
    total: str | None = None,
    salt: Sequence[Column] = (),
    weight: str | None = None,
) -> DataFrame:
    """0-based position of each row in the seeded shuffle of its group.

    With ``weight``, the sum of the weights of the rows before it instead.
    """
    keys = list(keys)
    cut = df.withColumn("_hex", draw_hex(seed, *salt, *ids)).withColumn(
        "_bucket", F.substring("_hex", 1, BUCKET_DIGITS)
    )
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    joined = _with_offsets(cut.withColumn("_one", w), keys, ["_one"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hex", *ids)
    if weight:
        here = F.coalesce(F.sum("_one").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        here = F.row_number().over(inside) - 1
    ranked = joined.withColumn(out, F.col("_off__one") + here)
    if total:
        ranked = ranked.withColumn(total, F.col("_one_total"))
    return ranked.drop("_hex", "_bucket", "_one", "_off__one", "_one_total")


def nested_hash_rank(df: DataFrame, outer: str, inner: str, ids: Sequence[str], seed: int | str) -> DataFrame:
    """``_outer`` and ``_inner``: the positions of :func:`hash_rank` in the groups of ``outer`` and of (``outer``, ``inner``), from one shuffle of the rows.

    Groups are cut into as many buckets as the number of rows asks for. A row without ``inner`` has no ``_inner``, one without ``outer`` is dropped.
    """
    rows, digits = df.count(), 1
    while digits < BUCKET_DIGITS and rows > 16 ** digits << 16:
        digits += 1
    cut = df.where(F.col(outer).isNotNull()).withColumn("_hex", draw_hex(seed, *ids)).withColumn("_bucket", F.substring("_hex", 1, digits))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(outer, inner, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.groupBy(outer, "_bucket").agg(F.sum("_n").alias("_n")).select(outer, "_bucket", F.coalesce(F.sum("_n").over(before(outer)), F.lit(0)).alias("_o"))
    inner_starts = totals.where(F.col(inner).isNotNull()).select(outer, inner, "_bucket", F.coalesce(F.sum("_n").over(before(outer, inner)), F.lit(0)).alias("_i"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = cut.repartition(parts, outer, "_bucket")
    here = {
        "_outer": F.row_number().over(Window.partitionBy(outer, "_bucket").orderBy("_hex", *ids)) - 1,
        "_inner": F.row_number().over(Window.partitionBy(outer, "_bucket", inner).orderBy("_hex", *ids)) - 1,
    }
    ranked = placed.withColumns(here).join(starts, [outer, "_bucket"]).join(inner_starts, [outer, inner, "_bucket"], "left")
    return ranked.withColumns({"_outer": F.col("_outer") + F.col("_o"), "_inner": F.col("_inner") + F.col("_i")}).drop("_hex", "_bucket", "_o", "_i")


def value_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str | None = None,
    out: str = "rank",
    descending: bool = False,
    total: str | None = None,
) -> DataFrame:
    """0-based position by ``value``, equal values ordered by the numeric column ``tie``.

    Without ``tie`` the values themselves must be unique inside a group. With it,
    a value shared by many rows is cut a second time by buckets of the tie column.
    """
    keys = list(keys)
    one = F.lit(1).cast("long")
    signed = df.withColumn("_v", F.col(value).cast("double") * (-1 if descending else 1))
    if tie is None:
        joined = _with_offsets(signed.withColumns({"_bucket": value_bucket("_v"), "_one": one}), keys, ["_one"])
        inside = Window.partitionBy(*keys, "_bucket").orderBy("_v")
        start = F.col("_off__one")
    else:
        smaller = prefix_sums(signed, keys, "_v", {"_below": one}).select(
            *keys, "_v", "_below_before", "_below_total"
        )
        cut = signed.join(smaller, [*keys, "_v"]).withColumns(
            {"_bucket": value_bucket(tie), "_one": one}
        )
        joined = _with_offsets(cut, [*keys, "_v"], ["_one"]).withColumn("_one_total", F.col("_below_total"))
        inside = Window.partitionBy(*keys, "_v", "_bucket").orderBy(tie)
        start = F.col("_below_before") + F.col("_off__one")
    ranked = joined.withColumn(out, start + F.row_number().over(inside) - 1)
    if total:
        ranked = ranked.withColumn(total, F.col("_one_total"))
    return ranked.drop("_v", "_bucket", "_one", "_off__one", "_one_total", "_below_before", "_below_total")


def array_split_part(rank: Column, total: Column, parts: int) -> Column:
    """Which of ``parts`` near-equal consecutive chunks a 0-based rank falls in."""
    size = F.floor(total / parts)
    extra = total % parts
    edge = extra * (size + 1)
    return (
        F.when(rank < edge, F.floor(rank / (size + 1)))
        .otherwise(extra + F.floor((rank - edge) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, from running counts of distinct values."""
    table = prefix_sums(df.where(F.col(value).isNotNull()), keys, value, {"_n": F.lit(1)})
    upto = F.col("_n_before") + F.col("_n")
    aggs = []
    for name, p in probs.items():
        spot = (F.col("_n_total") - 1) * F.lit(float(p))
        low = F.min(F.when(upto > F.floor(spot), F.col(value)))
        high = F.min(F.when(upto > F.ceil(spot), F.col(value)))
        frac = F.max(spot - F.floor(spot))
        aggs.append((low + (high - low) * frac).alias(name))
    return table.groupBy(*keys).agg(*aggs)
