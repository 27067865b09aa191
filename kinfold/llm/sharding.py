"""Shards of nearly equal bytes by a minimax contiguous partition of atomic groups.

Rows with equal texts (null counts as empty) are one atomic group: they share a 64-bit hash
and lie in one shard. Groups are ordered by that hash and the order is cut into
consecutive shards so that the largest shard is as small as it can be: a binary search finds the smallest capacity
with which the groups, packed greedily from the front, need no more shards than there are.
With that capacity kept, each cut is then the known boundary nearest to an even
share of what is left. A group that is larger than an even share of what the others leave would
make every other shard's limit as large as itself, so such groups (at most ``shards - 1``)
come first in the order, each as a shard of its own.

The driver never holds the groups. It holds segments: ranges of the hash with their sums, at most
``2 ** TOP`` at first. A greedy packing that treats a segment as one piece needs at least the true capacity, one that
may cut a segment anywhere needs at most it; only segments in which the two put a cut differently are
looked at again, ``2 ** STEP`` parts each, until what is left around the cuts are single
groups. So the result is the exact optimum over all groups, from a summary of bounded size.

Everything distributed is an SQL function. Texts of one 64-bit hash that differ travel together, which
keeps every promise. A null id is an id like any other; repeated rows have a slot each. An empty
table gives an empty result, and more shards than groups leave shards empty. Columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.ranking import hash_rank
from kinfold.session import durable

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Leading bits of the hash that the first summary tells apart, and bits added each time a segment is looked at again.
TOP, STEP = 16, 6
#: A segment of more than this part of an even shard is looked at again in any case.
COARSE = 64


class Cuts(NamedTuple):
    """Where the shards lie: ``heavy`` hashes have the first shards, ``edges`` are the first hashes of the shards after the next one."""

    heavy: tuple[int, ...]
    edges: tuple[int, ...]
    capacity: int


class Segments(NamedTuple):
    """Consecutive ranges of the hash: first hash, bits below the range's prefix, whether it is one group, and running sums."""

    low: list[int]
    shift: list[int]
    single: list[bool]
    ends: list[int]


def text_key(text: str | Column = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def row_size(text: str | Column = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long") + ROW_BYTES


def packed_ends(seg: Segments, parts: int, capacity: int, fluid: bool) -> list[int]:
    """Where each of ``parts`` shards ends if packed greedily; ``fluid``: a segment of several groups may be cut anywhere."""
    x, total, out = 0, seg.ends[-1], []
    for _ in range(parts):
        x = min(x + capacity, total)
        s = bisect_right(seg.ends, x) - 1
        if s < len(seg.single) and (seg.single[s] or not fluid):
            x = seg.ends[s]
        out.append(x)
    return out


def least_capacity(seg: Segments, parts: int, fluid: bool) -> int:
    total = seg.ends[-1]
    low, high = -(-total // parts), total
    while low < high:
        middle = (low + high) // 2
        if packed_ends(seg, parts, middle, fluid)[-1] == total:
            high = middle
        else:
            low = middle + 1
    return low


def _mirrored(seg: Segments) -> Segments:
    total = seg.ends[-1]
    return Segments(seg.low[::-1], seg.shift[::-1], seg.single[::-1], [total - e for e in reversed(seg.ends)])


def undecided(seg: Segments, parts: int) -> list[int]:
    """Segments of several groups that may hold a cut of the greedy packing from the front or from the back."""
    total, n = seg.ends[-1], len(seg.single)
    coarse = [i for i in range(n) if not seg.single[i] and (seg.ends[i + 1] - seg.ends[i]) * COARSE * parts > total]
    if coarse:
        return coarse
    low, high = least_capacity(seg, parts, True), least_capacity(seg, parts, False)
    found = set()
    for view, place in ((seg, lambda i: i), (_mirrored(seg), lambda i: n - 1 - i)):
        for a, b in zip(packed_ends(view, parts, low, False), packed_ends(view, parts, high, True), strict=True):
            found.update(place(i) for i in range(bisect_right(view.ends, a) - 1, bisect_left(view.ends, b)) if not view.single[i])
    return sorted(found)


def even_cuts(seg: Segments, parts: int, capacity: int) -> list[int]:
    """Segments that begin a new shard: no shard above ``capacity``, each cut as near to an even share of the rest as that allows."""
    total, ends = seg.ends[-1], seg.ends
    rest = [total - e for e in packed_ends(_mirrored(seg), parts, capacity, False)][::-1]  # from here on the rest fits into the shards left
    cuts, at = [], 0
    for k in range(1, parts):
        first, last = bisect_left(ends, max(at, rest[k])), bisect_right(ends, min(at + capacity, total)) - 1
        goal = at + (total - at) / (parts - k + 1)
        i = min(max(bisect_left(ends, goal), first), last)
        if i > first and goal - ends[i - 1] < ends[i] - goal:
            i -= 1
        at = ends[i]
        cuts.append(i)
    return cuts


def _refined(seg: Segments, which: list[int], look: Callable[[int, list[int]], list]) -> Segments:
    """The segments, those of ``which`` replaced by their parts as ``look(shift, prefixes)`` tells them."""
    parts: list[tuple] = []
    replaced = set(which)
    for shift in sorted({seg.shift[i] for i in which}):
        parts += look(shift, [seg.low[i] >> shift for i in which if seg.shift[i] == shift])
    parts += [(seg.low[i], seg.shift[i], seg.single[i], seg.ends[i + 1] - seg.ends[i]) for i in range(len(seg.low)) if i not in replaced]
    return _segments(parts)


def _segments(parts: list[tuple]) -> Segments:
    parts = sorted(parts)
    return Segments([p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], [0, *accumulate(p[3] for p in parts)])


def fit(docs: DataFrame, shards: int, text: str = "text") -> Cuts:
    """The cuts for ``shards`` shards of ``docs``."""
    groups = durable(docs.select(text_key(text).alias("key"), row_size(text).alias("size")).groupBy("key").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy: list[int] = []
    for row in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if row["size"] * (shards - len(heavy)) <= total:
            break
        heavy.append(row["key"])
        total -= row["size"]
    light = groups.where(~F.col("key").isin(heavy)) if heavy else groups
    parts = shards - len(heavy)

    def summed(rows: DataFrame, shift: int) -> list[tuple]:
        found = rows.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        return [(r["prefix"] << shift, shift, r["n"] == 1, r["size"]) for r in found.collect()]  # at most 2 ** TOP, or 2 ** STEP for a segment

    def look(shift: int, prefixes: list[int]) -> list[tuple]:
        return summed(light.where(F.shiftright("key", shift).isin(prefixes)), max(0, shift - STEP))

    seg = _segments(summed(light, 64 - TOP))
    if not seg.low:
        return Cuts(tuple(heavy), (), 0)
    while which := undecided(seg, parts):
        seg = _refined(seg, which, look)
    capacity = least_capacity(seg, parts, False)
    edges = [seg.low[i] if i < len(seg.low) else None for i in even_cuts(seg, parts, capacity)]
    return Cuts(tuple(heavy), tuple(e for e in edges if e is not None), capacity)


def shard_of(cuts: Cuts, text: str | Column = "text") -> Column:
    """The shard of a text."""
    key = text_key(text)
    out = F.lit(len(cuts.heavy))
    for edge in cuts.edges:
        out = out + (key >= F.lit(edge)).cast("int")
    for i, hash_ in reversed(list(enumerate(cuts.heavy))):
        out = F.when(key == F.lit(hash_), F.lit(i)).otherwise(out)
    return out.cast("int")


def place(docs: DataFrame, cuts: Cuts, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs``; slots of a shard are 0, 1, 2, ... in a hashed order."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_size(text).alias("size"), F.crc32(whole).alias("text_crc32"), shard_of(cuts, text).alias("shard"), text_key(text).alias("key"))
    named = rows.withColumn("name", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return hash_rank(named, ["shard"], ["name", "key"], seed=0, out="slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """:func:`place` with the cuts of the same rows."""
    return place(docs, fit(docs, shards, text), text)
