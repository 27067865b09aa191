"""Exact k-nearest neighbours by cosine, as a Spark join that prunes.

Unit vectors make cosine order equal Euclidean order, which obeys the triangle
inequality. Base rows go to the nearest of a few pivots and every cell is cut, in
order of distance to its pivot, into blocks of bounded size: thin shells, each known by
its least and greatest distance. A first pass compares every query with the shell it
lies in, which bounds its k-th distance; a second one visits only shells that the
bound does not rule out. Neighbouring shells form slabs: a query is sent to a slab once, with a
bit for each shell, and a task compares many queries with a slab by products of matrices,
keeping what its shrinking bounds allow. Shells that most of a task's queries visit are compared in tiles that
stay in the processor's cache, and bits are looked up for the few pairs that pass. (Voronoi-partitioned kNN join: Lu, Shen, Chen, Ooi, VLDB 2012;
distance-ordered cells: Jagadish et al., iDistance, TODS 2005.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw_hex
from kinfold.functions.rows import attach_row
from kinfold.operators.gram import vector_sum
from kinfold.operators.shuffles import shuffled_codes
from kinfold.session import durable

_TIE_DIGITS = 9
_SLACK = 1e-6  # distances of unit vectors come from cosines, so small ones are exact to about 1e-8 only
MAX_BLOCKS = 1 << 18  # the shells' bounds (32 bytes each) are on the driver and in every task
SLAB_VALUES = 1 << 22  # numbers in the rows, and in the queries, that meet in one task: 65,536 vectors of 64 dimensions
TASK_ROWS = 1 << 13  # rows whose visits one task finds
_SIDE = 2048  # queries whose products with a shell are in memory at a time
_TILE = 512  # queries, and rows, of a tile of crowded shells


def _unit(column) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype("float64")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    x = np.concatenate(flat).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is true, eight at a time: few are."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.divmod(np.flatnonzero(flat), mask.shape[1])
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flat[at]], mask.shape[1])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class _Shells:
    """Bounds of all blocks in order of (cell, distance): what decides which blocks a query visits."""

    def __init__(self, pivots: np.ndarray, meta: pd.DataFrame):
        self.pivots, self.n_blocks = pivots, len(meta)
        self.block, self.rows, self.least_id = (meta[c].to_numpy() for c in ("block", "n", "first_id"))
        self.low, self.high = meta["low"].to_numpy(), meta["high"].to_numpy()
        cells, self.start, self.count = np.unique(meta["cell"].to_numpy(), return_index=True, return_counts=True)
        self.centres = pivots[cells]
        self.cell_low = np.minimum.reduceat(self.low, self.start)
        self.cell_high = np.maximum.reduceat(self.high, self.start)
        rows = min(max(1, SLAB_VALUES // pivots.shape[1]), max(1024, -(-int(self.rows.sum()) // 6)))
        self.slab = np.unique((np.cumsum(self.rows) - self.rows) // rows, return_inverse=True)[1]
        self.slab_start = np.flatnonzero(np.r_[True, self.slab[1:] != self.slab[:-1]])
        self.slab_rows = rows

    def own(self, v: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position of a block): shells around each query, cell after cell, until they hold ``need`` rows."""
        d = _distances(v, self.centres)
        open_, held, found = np.arange(len(v)), np.zeros(len(v), dtype="int64"), []
        for _ in range(len(self.centres)):
            cell = d[open_].argmin(axis=1)
            r = d[open_, cell] - _SLACK
            d[open_, cell] = np.inf
            spot = np.array([self.start[c] + min(np.searchsorted(self.high[self.start[c] : self.start[c] + self.count[c]], x), self.count[c] - 1) for c, x in zip(cell, r, strict=True)], dtype="int64")
            found.append((open_, spot))
            held[open_] += self.rows[spot]
            open_ = open_[held[open_] < need]
            if not len(open_):
                break
        return np.concatenate([q for q, _ in found]), np.concatenate([b for _, b in found])

    def beyond(self, v: np.ndarray, bound: np.ndarray, bound_id: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position of a block) of the blocks that may hold a nearer row, without those of ``own``."""
        d = _distances(v, self.centres)
        q, cell = np.nonzero(self._least(d, self.cell_low, self.cell_high) <= bound[:, None] + 1e-9)
        times = self.count[cell]
        spot = np.repeat(self.start[cell] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(q) else np.array([], dtype="int64")
        at, q = np.repeat(d[q, cell], times), np.repeat(q, times)
        keep = self._least(at, self.low[spot], self.high[spot]) <= bound[q] + 1e-9
        keep &= (bound[q] > 0) | (self.least_id[spot] < bound_id[q])  # nothing is nearer than zero, so only a smaller id counts
        q, spot = q[keep], spot[keep]
        flags = np.zeros((len(v), self.n_blocks), dtype=bool)
        flags[q, spot] = True
        flags[self.own(v, need)] = False
        return np.nonzero(flags)

    @staticmethod
    def _least(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(d - high, low - d) - _SLACK, 0.0) ** 2 / 2.0


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    *,
    k: int,
    row_id: str = "row_id",
    vec: str = "vec",
    exclude_self: bool = True,
    n_pivots: int | None = None,
    block_rows: int = 4096,
    stats: dict | None = None,
) -> DataFrame:
    """(query, neighbor, distance, rank): the ``k`` nearest base rows of every query.

    Equal distances (to nine digits) are ordered by the neighbour's id. Rows without a vector take no
    part. The driver sees the pivots, the blocks' bounds and the visits of each block, at most ``MAX_BLOCKS``
    of them: beyond that many blocks of ``block_rows`` rows, blocks grow. ``stats`` receives the numbers of
    compared pairs (``pairs``) and of all pairs (``all_pairs``).
    """
    b = base.where(F.col(vec).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vec).alias("v"))
    q = queries.where(F.col(vec).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vec).alias("v"))
    total = b.count()
    n_pivots = n_pivots or int(min(4096, max(8, total**0.5)))
    picked = b.withColumn("_o", draw_hex("pivot", "id")).orderBy("_o", "id").limit(n_pivots).select("v").toPandas()
    if picked.empty:
        return q.select(F.col("id").alias("query")).limit(0).selectExpr("query", "query AS neighbor", "0.0D AS distance", "0 AS rank")
    pivots = _unit(picked["v"])
    need = k + (1 if exclude_self else 0)
    parts = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, -(-total // TASK_ROWS)))
    size = max(block_rows, need, -(-total // (MAX_BLOCKS // 2)))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_unit(pdf["v"]), pivots)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": d.argmin(1).astype("int32"), "r": d.min(1)})

    def cut(batches):
        cell, filled, block = None, 0, -1
        for pdf in batches:
            cells, out = pdf["cell"].to_numpy(), np.empty(len(pdf), dtype="int64")
            edges = np.r_[np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]), len(pdf)] if len(pdf) else np.array([0])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if cells[lo] != cell or block < 0:
                    cell, filled, block = cells[lo], 0, block + 1
                step = (filled + np.arange(hi - lo)) // size
                out[lo:hi] = block + step
                block, filled = block + int(step[-1]), (filled + hi - lo - 1) % size + 1
            yield pdf.assign(block=pdf["part"].to_numpy() * (1 << 32) + out)[["id", "v", "cell", "r", "block"]]

    ordered = b.repartition(parts, "id").mapInPandas(assign, "id long, v array<double>, cell int, r double").withColumn("s", F.round("r", 6))
    ordered = ordered.repartitionByRange("cell", "s", "id").sortWithinPartitions("cell", "s", "id").withColumn("part", F.spark_partition_id().cast("long"))
    shelves = durable(ordered.drop("s").mapInPandas(cut, "id long, v array<double>, cell int, r double, block long"))
    meta = shelves.groupBy("block").agg(F.first("cell").alias("cell"), F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.min("id").alias("first_id"))
    shells = _Shells(pivots, meta.toPandas().sort_values(["cell", "high", "first_id"], ignore_index=True))
    shared = q.sparkSession.sparkContext.broadcast(shells)

    def visits(batches):
        s = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                v = _unit(part["v"])
                i, spot = s.beyond(v, part["bound"].to_numpy(), part["bound_id"].to_numpy(), need) if "bound" in part else s.own(v, need)
                flags = np.zeros((len(part), s.n_blocks), dtype=bool)
                flags[i, spot] = True
                to = [[] for _ in range(len(part))]
                for slab in np.unique(s.slab[spot]).tolist():
                    own = flags[:, s.slab_start[slab] : s.slab_start[slab + 1] if slab + 1 < len(s.slab_start) else s.n_blocks]
                    bits = np.packbits(own, axis=1)
                    for j in np.flatnonzero(own.any(axis=1)).tolist():
                        to[j].append((slab, bits[j].tobytes()))
                yield part.assign(to=to, pairs=flags @ s.rows)

    def compared(asked: DataFrame) -> DataFrame:
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
        visited = durable(asked.repartition(parts, "id").mapInPandas(visits, shape + ", to array<struct<slab:int,bits:binary>>, pairs long"))
        sent = np.zeros(len(shells.slab_start), dtype="int64")
        for row in visited.select(F.explode("to.slab").alias("slab")).groupBy("slab").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
            sent[row.slab] = row.n
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + (visited.agg(F.sum("pairs")).first()[0] or 0)
            stats["sent"] = stats.get("sent", 0) + int(sent.sum())
        chunks = -(-sent // shells.slab_rows)
        dealt = q.sparkSession.sparkContext.broadcast((chunks, dict(zip(shells.block.tolist(), range(shells.n_blocks), strict=True))))

        def locate(batches):
            for pdf in batches:
                spot = pdf["block"].map(dealt.value[1]).to_numpy()
                slab = shared.value.slab[spot]
                yield pdf[["id", "v"]].assign(spot=spot - shared.value.slab_start[slab], slab=slab, n=dealt.value[0][slab])

        per_slab = F.array(*[F.lit(int(n)) for n in chunks])
        left = visited.select(*asked.columns, F.explode("to").alias("_to")).select(*asked.columns, "_to.*")
        left = left.withColumn("chunk", F.pmod(F.xxhash64("id"), F.get(per_slab, F.col("slab"))).cast("int"))
        right = shelves.select("id", "v", "block").mapInPandas(locate, "id long, v array<double>, spot int, slab int, n int").where("n > 0")
        right = right.select("id", "v", "spot", "slab", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
        tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, 4 * int(chunks.sum())))
        sides = [side.repartition(tasks, "slab", "chunk").groupBy("slab", "chunk") for side in (left, right)]
        return sides[0].cogroup(sides[1]).applyInArrow(match, "query long, neighbor long, distance double")

    def match(lhs: pa.Table, rhs: pa.Table) -> pa.Table:
        names = ["query", "neighbor", "distance"]
        if not lhs.num_rows or not rhs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, spots, asking = rhs["id"].to_numpy(), rhs["spot"].to_numpy(), lhs["id"].to_numpy()
        order = np.lexsort((ids, spots))
        ids, spots = ids[order], spots[order]
        bv, qv = _matrix(rhs["v"])[order], _matrix(lhs["v"])
        bs, qs = bv.astype("float32"), qv.astype("float32")
        margin = np.float32((bv.shape[1] + 8) * 1.2e-7)  # more than products of rounded unit vectors can be off
        bounded = "bound" in lhs.column_names
        bound = lhs["bound"].to_numpy() if bounded else np.full(len(qv), np.inf)
        bound_id = lhs["bound_id"].to_numpy() if bounded else np.zeros(len(qv), dtype="int64")
        bits = np.frombuffer(b"".join(lhs["bits"].to_pylist()), np.uint8).reshape(len(qv), -1)
        best, best_id = np.full((len(qv), k), np.inf), np.full((len(qv), k), np.iinfo("int64").max)

        def least(own):
            return (1.0 - np.minimum(bound[own], best[:, -1][own]) - 1e-9).astype("float32") - margin

        def keep(i, j):
            d = np.round(1.0 - np.concatenate([np.einsum("ij,ij->i", qv[i[x : x + 65536]], bv[j[x : x + 65536]]) for x in range(0, len(i), 65536)]), _TIE_DIGITS)
            j = ids[j]
            fits = (d < bound[i]) | ((d == bound[i]) & (j < bound_id[i]))
            if exclude_self:
                fits &= asking[i] != j
            i, j, d = i[fits], j[fits], d[fits]
            some = np.unique(i)
            i, j, d = np.r_[i, np.repeat(some, k)], np.r_[j, best_id[some].ravel()], np.r_[d, best[some].ravel()]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype="int64")
            place_of = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            top = place_of < k
            best[i[top], place_of[top]], best_id[i[top], place_of[top]] = d[top], j[top]

        edges = np.r_[np.flatnonzero(np.r_[True, spots[1:] != spots[:-1]]), len(spots)]
        crowded = np.zeros(len(spots), dtype=bool)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            visitors = np.flatnonzero(bits[:, spots[lo] >> 3] & (128 >> (spots[lo] & 7)))
            if bounded and 2 * len(visitors) > len(qv):
                crowded[lo:hi] = True
                continue
            for start in range(0, len(visitors), _SIDE):
                own = visitors[start : start + _SIDE]
                near = qs[own] @ bs[lo:hi].T
                floor = least(own)
                free = np.flatnonzero(np.isinf(floor))
                if len(free) and hi - lo > need:
                    floor[free] = np.partition(near[free], hi - lo - need, axis=1)[:, hi - lo - need] - 2 * margin
                i, j = _true(near >= floor[:, None])
                if len(i):
                    keep(own[i], lo + j)
        rows = np.flatnonzero(crowded)
        tiles = [rows[x : x + _TILE] for x in range(0, len(rows), _TILE)]
        bs = [np.ascontiguousarray(bs[tile].T) for tile in tiles]
        products, passed = np.empty(_TILE * _TILE, dtype="float32"), np.empty(_TILE * _TILE, dtype=bool)
        for start in range(0, len(qv) if tiles else 0, _TILE):
            own = np.arange(start, min(start + _TILE, len(qv)))
            floor, found, waiting = least(own)[:, None], [], 0
            for at, (tile, turned) in enumerate(zip(tiles, bs, strict=True)):
                shape = (len(own), len(tile))
                near, mask = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in (products, passed))
                np.matmul(qs[own[0] : own[-1] + 1], turned, out=near)
                i, j = _true(np.greater_equal(near, floor, out=mask))
                i, j = own[i], tile[j]
                asked_for = (bits[i, spots[j] >> 3] & (128 >> (spots[j] & 7))) > 0
                found.append((i[asked_for], j[asked_for]))
                waiting += len(found[-1][0])
                if waiting > (8 * _TILE if at + 1 < len(tiles) else 0):
                    keep(*map(np.concatenate, zip(*found, strict=True)))
                    floor, found, waiting = least(own)[:, None], [], 0
        row, at = np.nonzero(np.isfinite(best))
        return pa.table([pa.array(x) for x in (asking[row], best_id[row, at], best[row, at])], names=names)

    first = durable(compared(q))
    kth = first.groupBy("query").agg(F.get(F.sort_array(F.collect_list(F.struct("distance", "neighbor"))), F.lit(k - 1)).alias("_k"))
    bound = F.coalesce(F.col("_k.distance"), F.lit(float("inf"))).alias("bound")
    asked = q.join(durable(kth), q["id"] == F.col("query"), "left").select("id", "v", bound, F.coalesce(F.col("_k.neighbor"), F.lit(0)).alias("bound_id"))
    if stats is not None:
        stats["all_pairs"] = total * q.count()
    w = Window.partitionBy("query").orderBy("distance", "neighbor")
    return first.unionByName(compared(asked)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbor_purity(neighbors: DataFrame, labels: DataFrame, *, row_id: str, label: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean share of neighbours that carry the query's label."""
    a = labels.select(*by, F.col(row_id).alias("query"), F.col(label).alias("_lq"))
    b = labels.select(*by, F.col(row_id).alias("neighbor"), F.col(label).alias("_ln"))
    j = neighbors.join(a, "query").join(b, [*by, "neighbor"])
    per = j.groupBy(*by, "query").agg((F.count_if(F.col("_lq") == F.col("_ln")) / F.lit(k)).alias("_p"))
    return per.groupBy(*by).agg(F.avg("_p").alias("purity"), F.count("*").alias("n_queries"))


def purity_null(neighbors: DataFrame, rows: DataFrame, *, row_id: str, label: str, k: int, n: int = 1000, seed: int) -> DataFrame:
    """(perm, purity) under ``n`` relabellings of ``rows``: a pair of neighbours compares its drawn labels, a byte for each draw, and matches are summed inside the tasks."""
    drawn = durable(shuffled_codes(rows, row_id=row_id, label=label, n=n, seed=seed))
    a, b = (drawn.select(F.col(row_id).alias(end), F.col("_codes").alias(f"_{end}")) for end in ("query", "neighbor"))

    def count(batches):
        hits = np.zeros(n)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                x, y = (np.stack([np.frombuffer(c, np.uint8 if len(c) == n else np.uint32) for c in batch.column(end).slice(i, 2048).to_pylist()]) for end in ("_query", "_neighbor"))
                hits += ((x == y) & (x > 0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([hits], pa.list_(pa.float64()))], names=["_same"])

    pairs = neighbors.select("query", "neighbor").join(a, "query").join(b, "neighbor").select("_query", "_neighbor")
    sums = pairs.mapInArrow(count, "_same array<double>").agg(vector_sum("_same").alias("_hits"))
    queries = neighbors.select("query").distinct().agg(F.count(F.lit(1)).alias("_n"))
    return attach_row(sums, queries).select(F.posexplode("_hits").alias("perm", "_h"), "_n").select("perm", (F.col("_h") / (F.col("_n") * k)).alias("purity"))


def knn_vote(neighbors: DataFrame, labels: DataFrame, *, row_id: str, label: str, classes, k: int) -> DataFrame:
    """Vote shares per declared class and the winning class (the first declared one on a tie)."""
    votes = neighbors.join(labels.select(F.col(row_id).alias("neighbor"), F.col(label).alias("_l")), "neighbor")
    shares = votes.groupBy("query").agg(
        *[(F.count_if(F.col("_l") == c) / F.count("*")).alias(f"_s{i}") for i, c in enumerate(classes)]
    )
    from kinfold.functions.vector_expr import argmax_label

    proba = F.array(*[F.col(f"_s{i}") for i in range(len(classes))])
    return shares.select(F.col("query").alias(row_id), proba.alias("proba")).withColumn("pred", argmax_label("proba", classes))
