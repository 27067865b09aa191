"""Connected components of a link table, as joins and minima.

Alternates two steps until nothing changes: every node sends its larger
neighbours to the smallest id it knows, then its smaller ones. The number of
rounds grows with the logarithm of the longest chain, the table never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import durable


def _towards_least(links: DataFrame, larger: bool) -> DataFrame:
    """(a, b) with a < b: each node's neighbours (the larger ones, or the smaller and itself) tied to its smallest."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    swapped = both.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = both.unionByName(swapped) if larger else swapped
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.where("v > u") if larger else near.unionByName(swapped.select("u", F.col("u").alias("v")).distinct())
    return moved.join(least, "u").where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a < b): component is the smallest id reachable."""
    now = durable(links.select("a", "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        now = durable(_towards_least(_towards_least(now, True), False))
    heads = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return durable(now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(heads))
