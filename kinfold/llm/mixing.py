"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents is worth. The whole part is given; the fractional parts are rounded
together: two documents exchange probability mass, in inverse ratio to their
sizes and in a random direction that keeps both expectations, until one of them
is integral. So the words of a pair, and with them of the source, stay the same
at every step. A bucket of a source's documents ends with at most one fractional
document; those meet in the next level of a reduction tree, until one is left
for a source, and its rounding is all that the words can miss the target by.

Every draw is a hash of the two ids and buckets are cut by a hash of the id, so a
rerun or a lost executor gives the same mix. A null text has size 0; a document
of size 0 adds no words, takes no part in the rounding and gets the whole part only.
Rows that repeat are rounded each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import hashable, named, splitmix
from kinfold.session import durable

#: Documents of one bucket, and buckets that meet in a node of the tree.
BUCKET = 5000
FAN_IN = 64
#: No document is taken more often.
MOST = 3

_ROW = "doc_id long, row_key long, source string, size long, share double, copies long, bucket long"


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row; rows that share it and the id are repetitions."""
    return F.xxhash64(*hashable(docs), F.lit(11))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, source, size): words of each text."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row_key"), F.col("source").cast("string"), words.alias("size"))


def numbered(values: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values with their 0-based rank, null last: ranks inside ranges, plus the sizes of the ranges before."""
    ordered = F.col(column).asc_nulls_last()
    ranged = durable(values.select(column).distinct().repartitionByRange(ordered).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").count()
    before = parts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(ordered)) - 1
    return ranged.join(before, "_part").select(column, (F.col("_before") + rank).alias(out))


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target): all words shared by the weights 1, 2, 3, repeating, none above ``MOST`` times its size.

    Each pass shares what is left among the sources not yet at their limit; the limits only ever grow in number.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = numbered(totals, "source", "_rank")
    totals = totals.withColumnRenamed("source", "_source")
    known = durable(order.join(totals, F.col("source").eqNullSafe(F.col("_source"))).select("source", "source_size", "n_docs", (F.col("_rank") % 3 + 1).alias("weight")))
    whole = known.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        limited = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        capped, weight, count = known.agg(F.sum(F.when(limited, F.col("source_size"))), F.sum(F.when(~limited, F.col("weight"))), F.count(F.when(limited, 1))).first()
        if count == full or not weight:
            break
        full, level = count, (whole - MOST * (capped or 0)) / weight
    return known.select("source", "source_size", "n_docs", F.least(F.col("weight") * F.lit(float(level)), (MOST * F.col("source_size")).cast("double")).alias("target"))


def _draw(a: int, b: int) -> float:
    mixed = splitmix(np.array([(a * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return int(mixed[0] >> np.uint64(11)) / float(1 << 53)


def pivot(keys: list[int], weights: list[float], shares: list[float]) -> list[float]:
    """``shares`` after rounding in order: each 0 or 1, but for one at most; the weighted sum stays."""
    out = list(shares)
    held = -1
    for j in range(len(out)):
        if not 0.0 < out[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, ratio = held, weights[held] / weights[j]
        up = min(1.0 - out[i], out[j] / ratio)
        down = min(out[i], (1.0 - out[j]) / ratio)
        step = up if _draw(keys[i], keys[j]) * (up + down) < down else -down
        first_ends = abs(step) == (1.0 - out[i] if step > 0 else out[i])
        if first_ends:
            out[j] = min(1.0, max(0.0, out[j] - step * ratio))
            out[i] = 1.0 if step > 0 else 0.0
            held = j if 0.0 < out[j] < 1.0 else -1
        else:
            out[i] = min(1.0, max(0.0, out[i] + step))
            out[j] = 0.0 if step > 0 else 1.0
            held = i if 0.0 < out[i] < 1.0 else -1
    return out


def _round(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "row_key", "doc_id"], ascending=[False, True, True], kind="stable")  # what is left over is small
    return group.assign(share=pivot(group["row_key"].tolist(), group["size"].tolist(), group["share"].tolist()))


def _last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One fractional document of a source: a coin with its share."""
    for rows in batches:
        coins = [float(_draw(k, 5) < s) if 0 < s < 1 else s for k, s in zip(rows["row_key"].tolist(), rows["share"].tolist(), strict=True)]
        yield rows.assign(share=coins)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, source, size, source_size, target, copies), one row per row of ``docs``."""
    rows = durable(sizes(docs))
    goal = durable(targets(rows)).withColumnRenamed("source", "_source")
    worth = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    spread = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET)).cast("long")
    level = rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "row_key", "source", "size", F.when(F.col("size") > 0, worth - F.floor(worth)).otherwise(F.lit(0.0)).alias("share"), F.floor(worth).alias("copies"),
        F.pmod(F.shiftright(F.abs(F.col("row_key")), 3), spread).alias("bucket"),
    )
    nodes = max(1, -(-(goal.agg(F.max("n_docs")).first()[0] or 0) // BUCKET))
    done = None
    while True:
        level = durable(level.groupBy("source", "bucket").applyInPandas(_round, _ROW))
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        if nodes == 1:
            level = level.mapInPandas(_last, _ROW)
            done = level if done is None else done.unionByName(level)
            break
        settled = level.where(~open_)
        done = settled if done is None else done.unionByName(settled)
        level = level.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        nodes = -(-nodes // FAN_IN)
    return done.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "row_key", "source", "size", "source_size", "target", (F.col("copies") + F.col("share").cast("long")).alias("copies")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plan = mix(docs).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    whole = docs.select(F.struct(*named(docs)).alias("row"), F.col("doc_id").cast("long").alias("at"), row_key(docs).alias("hash"))  # columns of any name
    plan = plan.select(F.col("doc_id").alias("id"), "row_key", "_copies")
    found = whole.dropDuplicates(["at", "hash"]).join(plan, F.col("at").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row_key")))  # repeated rows share their copies
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select("row.*")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words the mix takes of each document, repeats counted."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
