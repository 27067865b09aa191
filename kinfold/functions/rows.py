"""Putting totals next to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row frame (an aggregate without keys).

    A frame of any other number of rows raises, so the broadcast holds one row.
    """
    n = F.count(F.lit(1))
    sure = F.when(n == 1, n).otherwise(F.raise_error(F.lit("totals must be one row")).cast("long"))
    row = one.agg(sure.alias("_rows"), *[F.first(c).alias(c) for c in one.columns]).where("_rows = 1").drop("_rows")
    return df.crossJoin(F.broadcast(row))


def attach_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their group's totals; without keys there is one row of totals."""
    return df.join(totals, list(keys)) if keys else attach_row(df, totals)
