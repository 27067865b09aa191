"""Nearest neighbours by vantage-point trees, one for each shard of the table.

Rows are dealt to shards by a hash of their id; a shard's rows become one tree: a node's
vantage point splits the rest at the median distance, so equal vectors, however
many, are halved like any others. Queries travel in blocks to every shard. A block
descends level by level as arrays: first each query alone to the leaf that it falls in, which
bounds its k-th distance, then all nodes that the triangle inequality cannot rule out,
leaves in the order of their lower bounds. A node goes when ``factor`` times its
lower bound exceeds the k-th distance so far; a factor of 1 is the exact search, larger ones
visit fewer leaves. The k best of each shard meet by query.

Distances are Euclidean in double precision, equal ones ordered by id. Vectors that are null, zero
or hold null or non-finite components take no part; vectors are compared with those of
their own length. Rows that repeat an id are each a candidate, but never for a query of the same id; a repeated query
is asked once, with the smallest of its vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import durable

SHARD_ROWS = 20_000
BLOCK_ROWS = 1024
LEAF = 48
#: Recall against brute force is in the README; tight clusters need a small factor.
FACTOR = 1.5


class Tree(NamedTuple):
    """Nodes as arrays: ``child`` of an inner node is its first child, the second follows; of a leaf it is -1 - leaf number."""

    ids: np.ndarray
    vectors: np.ndarray
    vantage: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    leaves: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> Tree:
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    rng = np.random.default_rng(seed)
    vantage, radius, child, leaves = [-1], [0.0], [0], []
    todo = [(0, np.arange(len(ids)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= LEAF:
            child[node] = -1 - len(leaves)
            leaves.append(np.concatenate([rows, np.full(LEAF - len(rows), -1)]))
            continue
        at = int(rng.integers(len(rows)))
        point, rest = rows[at], np.delete(rows, at)
        far = np.sqrt(((vectors[rest] - vectors[point]) ** 2).sum(axis=1))
        half = len(rest) // 2
        split = np.argpartition(far, half)
        vantage[node], radius[node], child[node] = int(point), float(far[split[half]]), len(child)
        vantage += [-1, -1]
        radius += [0.0, 0.0]
        child += [0, 0]
        todo += [(child[node], rest[split[:half]]), (child[node] + 1, rest[split[half:]])]
    return Tree(ids, vectors, np.array(vantage), np.array(radius), np.array(child), np.array(leaves, np.int64).reshape(-1, LEAF))


class _Best:
    """The k nearest of each query so far."""

    def __init__(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.tree, self.own, self.vectors, self.k = tree, ids, vectors, k
        self.score = np.full((len(ids), k), np.inf)
        self.row = np.full((len(ids), k), np.iinfo(np.int64).max)  # rows ascend with ids

    @property
    def bound(self) -> np.ndarray:
        return self.score[:, -1]

    def distances(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        gap = self.tree.vectors[rows] - self.vectors[queries][:, None, :]
        return np.sqrt((gap**2).sum(axis=2))

    def offer(self, queries: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        """One row of candidates for each of the (distinct) queries; -1 is none."""
        out = (rows < 0) | (self.tree.ids[rows] == self.own[queries][:, None])
        score = np.concatenate([self.score[queries], np.where(out, np.inf, score)], axis=1)
        rows = np.concatenate([self.row[queries], np.where(out, np.iinfo(np.int64).max, rows)], axis=1)
        order = np.lexsort((rows, score))[:, : self.k]
        self.score[queries] = np.take_along_axis(score, order, 1)
        self.row[queries] = np.take_along_axis(rows, order, 1)


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, visited leaf rows): the k nearest found of each query, missing ones infinite."""
    best = _Best(tree, ids, vectors, k)
    everyone = np.arange(len(ids))
    node, at = np.zeros(len(ids), np.int64), everyone  # each query down to its own leaf
    while len(at):
        inner = tree.child[node] >= 0
        q = at[~inner]
        if len(q):
            rows = tree.leaves[-1 - tree.child[node[~inner]]]
            best.offer(q, rows, best.distances(q, rows))
        at, node = at[inner], node[inner]
        if len(at):
            d = best.distances(at, tree.vantage[node][:, None])[:, 0]
            node = tree.child[node] + (d > tree.radius[node])
    q, node, low = everyone, np.zeros(len(ids), np.int64), np.zeros(len(ids))
    points, reached = ([], [], []), ([], [], [])
    while len(q):
        leaf = tree.child[node] < 0
        for store, values in zip(reached, (q[leaf], -1 - tree.child[node[leaf]], low[leaf]), strict=True):
            store.append(values)
        q, node, low = q[~leaf], node[~leaf], low[~leaf]
        if not len(q):
            break
        point = tree.vantage[node]
        d = best.distances(q, point[:, None])[:, 0]
        for store, values in zip(points, (q, point, d), strict=True):
            store.append(values)
        gap = d - tree.radius[node]
        q = np.concatenate([q, q])
        node = np.concatenate([tree.child[node], tree.child[node] + 1])
        low = np.maximum(np.concatenate([low, low]), np.maximum(np.concatenate([gap, -gap]), 0.0))
        keep = factor * low <= best.bound[q]
        q, node, low = q[keep], node[keep], low[keep]
    for qs, rows, scores in _rounds(*(np.concatenate(p) if p else np.zeros(0, np.int64) for p in points)):
        best.offer(qs, rows[:, None], scores[:, None])
    q, leaf, low = (np.concatenate(r) for r in reached)
    order = np.lexsort((low, q))
    visited = 0
    for qs, leaves, lows in _rounds(q[order], leaf[order], low[order], presorted=True):
        alive = factor * lows <= best.bound[qs]
        qs, leaves = qs[alive], leaves[alive]
        if len(qs):
            rows = tree.leaves[leaves]
            visited += int((rows >= 0).sum())
            had = (rows[:, :, None] == best.row[qs][:, None, :]).any(axis=2)  # the first descent brought some already
            rows = np.where(had, -1, rows)
            best.offer(qs, rows, best.distances(qs, rows))
    return best.score, np.where(np.isfinite(best.score), tree.ids[np.minimum(best.row, len(tree.ids) - 1)], -1), visited


def _rounds(q: np.ndarray, item: np.ndarray, value: np.ndarray, presorted: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs in rounds that hold each query once, in order."""
    if not presorted:
        order = np.argsort(q, kind="stable")
        q, item, value = q[order], item[order], value[order]
    if not len(q):
        return
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    order = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank))
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        take = order[a:b]
        yield q[take], item[take], value[take]


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def nearest(rows: DataFrame, queries: Column, k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) that the condition names."""
    valid = rows.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), F.size("embedding").alias("d"), queries.alias("asked"))
    count, asked = valid.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-asked // BLOCK_ROWS))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        d = group.column("d")[0].as_py()
        vectors = group.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        tree = build(group.column("vec_id").to_numpy(), vectors)
        return pa.table({"shard": group.column("shard")[:1], "d": group.column("d")[:1], "tree": pa.array([pickle.dumps(tuple(tree), 5)], pa.binary())})

    def pack(group: pa.Table) -> pa.Table:
        flat = group.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"block": group.column("block")[:1], "d": group.column("d")[:1], "ids": pa.array([group.column("vec_id").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})

    trees = durable(valid.withColumn("shard", deal(shards, 1)).groupBy("shard", "d").applyInArrow(grow, "shard int, d int, tree binary"))
    once = valid.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    packs = durable(once.withColumn("block", deal(blocks, 2)).groupBy("block", "d").applyInArrow(pack, "block int, d int, ids binary, vectors binary"))
    everywhere = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # blocks of the stated queries, to every shard

    def look(pair: pa.Table) -> pa.Table:
        """One shard and one block: neither meets another in memory."""
        tree, d, ids, vectors = (pair.column(c)[0] for c in ("tree", "d", "ids", "vectors"))
        own = np.frombuffer(ids.as_buffer(), np.int64)
        score, found, _ = search(Tree(*pickle.loads(tree.as_buffer())), own, np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, d.as_py()), k, factor)
        there = np.isfinite(score)
        return pa.table({"query_id": pa.array(np.repeat(own, there.sum(axis=1))), "vec_id": pa.array(found[there]), "score": pa.array(score[there])})

    pairs = everywhere.join(trees, ["shard", "d"]).groupBy("shard", "block", "d")
    near = pairs.applyInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
