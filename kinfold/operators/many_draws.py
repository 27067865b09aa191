"""AUROC under many draws at once.

Exploding rows by draws multiplies the table by the number of draws and sorts every
copy. Here a row carries its multiplicities under all draws as one byte each, made once for
each cluster; rows are sorted once by score, and running sums are vectors with one entry per draw.
Statistics of counts need no order: a task multiplies its cells by their multiplicities and hands on sums.

Rows are partitioned by (group, score bucket) and read in score order as a stream,
so memory holds one batch and a few vectors whatever the bucket's size. Buckets hand
on their totals, and a last aggregation over the few buckets of a group adds what
lies below each of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.functions.hashing import LANES, digits, equally_long, md5_words
from kinfold.functions.ranking import value_bucket
from kinfold.operators.gram import vector_sum
from kinfold.session import durable

_CELLS = 4_000_000  # matrix entries held at a time
_UNITS, _DRAWS, _PLACES = 2048, 32, 1 << 16  # units whose hits are counted together; draws and places hashed together
NEGATIVE, POSITIVE, SPLIT = 0, 1, 2


def dense(n_draws: int):
    """A column function of two parallel lists (draw, multiplicity): one byte for each draw."""

    @F.arrow_udf("binary")
    def packed(draws: pa.Array, counts: pa.Array) -> pa.Array:
        out = np.zeros((len(draws), n_draws), np.uint8)
        rows = np.repeat(np.arange(len(draws)), draws.value_lengths().to_numpy(zero_copy_only=False))
        values = counts.flatten().to_numpy(zero_copy_only=False)
        if len(values) and (values.max() > 255 or values.min() < 0 or (values != np.floor(values)).any()):
            raise ValueError("multiplicities must be whole numbers up to 255")
        out[rows, draws.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = values
        return pa.array([r.tobytes() for r in out], pa.binary())

    return packed


def hit_numbers(lead: bytes, label: str, total: int, first: int, last: int, draws: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of the draws, one row for each): which of ``total`` indexes the places ``first`` to ``last`` hit, hashed in blocks."""
    for lo, hi in equally_long(first, last):
        for start in range(lo, hi, LANES):
            places = np.arange(start, min(start + LANES, hi))
            at = digits(places)
            for b0, b1 in equally_long(draws.start, draws.stop):
                many = max(1, LANES // len(places))
                for b in range(b0, b1, many):
                    own = np.arange(b, min(b + many, b1))
                    spot = digits(own) if len(own) > 1 else list(str(b).encode())
                    boot = [np.repeat(c, len(places)) for c in spot] if len(own) > 1 else spot
                    grid = [np.tile(c, len(own)) for c in at] if len(own) > 1 else at
                    h = md5_words([*lead, *boot, *f"|{label}|".encode(), *grid])[0].astype(np.int64)
                    yield own, (h - h // total * total).reshape(len(own), -1)


def hit_bytes(numbered: DataFrame, *, key: str, index: str, size: str, cluster: str, n_draws: int, seed: int | str) -> DataFrame:
    """(cluster, _m): how often ``size`` draws with replacement hit each index of a key, in one byte for each of ``n_draws``; indexes never hit are missing.

    Draw ``b`` of place ``i`` hits ``md5(seed|b|key|i)`` modulo the size. Places are hashed in blocks; what is shuffled are the hits of a block
    on ``_UNITS`` neighbouring indexes in ``_DRAWS`` draws, sorted, each as its distance to the one before: about one byte.
    """
    kinds = dict(numbered.dtypes)
    lead = f"{seed}|".encode()

    def hashed(label: str, total: int, first: int, last: int, draws: range) -> np.ndarray:
        """Hits of the places ``first`` to ``last`` as (block of indexes, draw, index inside the block) in one number, sorted."""
        found = []
        for own, hits in hit_numbers(lead, label, total, first, last, draws):
            block, inside = np.divmod(hits, _UNITS)
            found.append(((block * _DRAWS + (own - draws.start)[:, None]) * _UNITS + inside).ravel())
        return np.sort(np.concatenate(found))

    def throw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hits = hashed(r["_k"], r["_size"], r["_first"], min(r["_first"] + _PLACES, r["_size"]), range(r["_at"], min(r["_at"] + _DRAWS, n_draws)))
                block = hits // (_DRAWS * _UNITS)
                starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                steps = np.diff(hits, prepend=0)
                steps[starts] = hits[starts] % (_DRAWS * _UNITS)
                ends = np.cumsum(steps // 255 + 1)
                coded = np.full(ends[-1], 255, np.uint8)
                coded[ends - 1] = steps % 255
                cuts = np.r_[0, ends[starts[1:] - 1], len(coded)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["_k"]] * len(starts), pa.string()), pa.array(block[starts], pa.int64()), pa.array([r["_at"]] * len(starts), pa.int32()), pa.array([coded[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
                    names=["_k", "_block", "_at", "_hits"],
                )

    def count(hits: pa.Table, units: pa.Table) -> pa.Table:
        if not hits.num_rows:
            return units.select(["_c"]).append_column("_m", pa.nulls(units.num_rows, pa.binary())).slice(0, 0).rename_columns([cluster, "_m"])
        flat = []
        for at, coded in zip(hits.column("_at").to_pylist(), hits.column("_hits").to_pylist()):
            steps = np.frombuffer(coded, np.uint8)
            spots = np.cumsum(steps, dtype=np.int64)[steps != 255]
            flat.append(spots % _UNITS * n_draws + at + spots // _UNITS)
        counts = np.bincount(np.concatenate(flat), minlength=_UNITS * n_draws)
        if counts.max() > 255:
            raise ValueError("a unit was drawn more than 255 times")
        m = counts.astype(np.uint8).reshape(_UNITS, n_draws)[units.column("_i").to_numpy() % _UNITS]
        drawn = m.any(axis=1)
        return pa.Table.from_arrays([units.column("_c").filter(pa.array(drawn)), pa.array([r.tobytes() for r in m[drawn]], pa.binary())], names=[cluster, "_m"])

    upto = lambda n, step: F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long"))
    sizes = numbered.groupBy(F.col(key).alias("_k")).agg(F.max(F.col(size).cast("long")).alias("_size"))
    work = sizes.select("_k", "_size", F.explode(upto(F.col("_size"), _PLACES)).alias("_first")).select("*", F.explode(upto(F.lit(n_draws).cast("long"), _DRAWS)).alias("_at"))
    tasks = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64)
    thrown = work.repartition(tasks, "_k", "_first", "_at").mapInArrow(throw, "_k string, _block long, _at int, _hits binary")
    units = numbered.select(F.col(key).alias("_k"), F.floor(F.col(index) / _UNITS).alias("_block"), F.col(index).cast("long").alias("_i"), F.col(cluster).alias("_c"))
    return thrown.groupBy("_k", "_block").cogroup(units.groupBy("_k", "_block")).applyInArrow(count, f"`{cluster}` {kinds[cluster]}, _m binary")


def kept_bytes(clusters: DataFrame, *, cluster: str, n_draws: int, seed: int | str, n: int, keep: int) -> DataFrame:
    """(cluster, _m): 1 in each of ``n_draws`` where the cluster is among the ``keep`` of ``n`` with the least ``md5(seed|draw|cluster)``, else 0.

    The last one kept is looked for between two bounds around its expected place: tasks count what lies below and hand on what lies
    between, some multiples of the root of ``n``. Bounds that miss it in any draw are widened, at last to everything.
    """
    kinds = dict(clusters.dtypes)
    if not 0 < keep:
        return clusters.select(cluster, F.lit(None).cast("binary").alias("_m")).limit(0)
    lead = f"{seed}|".encode()
    rest = F.encode(F.coalesce(F.concat(F.lit("|"), F.col(cluster).cast("string")), F.lit("")), "UTF-8")
    texts = durable(clusters.select(F.col(cluster).alias("_c"), rest.alias("_t")).repartition(max(8, -(-n // LANES)), "_c"))

    def hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, draws, first and last 16 digits as signed numbers: one line for each draw) of texts of equal length."""
        raw = column.to_pylist()
        lengths = np.array([len(t) for t in raw])
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            for i in range(0, len(same), LANES):
                part = same[i : i + LANES]
                columns = [np.ascontiguousarray(c) for c in np.frombuffer(b"".join(raw[j] for j in part), np.uint8).reshape(len(part), length).T] if length else []
                many = max(1, LANES // len(part))
                for b0, b1 in equally_long(0, n_draws):
                    for b in range(b0, b1, many):
                        own = np.arange(b, min(b + many, b1))
                        boot = [np.repeat(c, len(part)) for c in digits(own)]
                        words = md5_words([*lead, *boot, *(np.tile(c, len(own)) for c in columns)])
                        high, low = (((x.astype(np.uint64) << np.uint64(32) | y) ^ np.uint64(1 << 63)).view(np.int64).reshape(len(own), -1) for x, y in (words[:2], words[2:]))
                        yield part, own, high, low

    middle, spread = keep / n, (keep / n * max(1 - keep / n, 1 / n) / n) ** 0.5
    reach, last = 5.0, {}
    while True:
        lo, hi = (max(middle - reach * spread, 0.0), min(middle + reach * spread, 1.0))
        least, most = (int(v * ((1 << 64) - 1)) - (1 << 63) for v in (lo, hi))
        least, most = max(least, -(1 << 63)), min(most, (1 << 63) - 1)

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = np.zeros(n_draws, np.int64)
            names = ["boot", "high", "low", "below"]
            for batch in batches:
                found = []
                for _, own, high, low in hashes(batch.column("_t")):
                    below[own] += (high < least).sum(axis=1)
                    at = np.nonzero((high >= least) & (high <= most))
                    found.append((own[at[0]], high[at], low[at]))
                boot, high, low = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(boot, pa.int32()), pa.array(high), pa.array(low), pa.nulls(len(boot), pa.int64())], names=names)
            some = np.flatnonzero(below)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), none, none, pa.array(below[some])], names=names)

        seen = durable(texts.select("_t").mapInArrow(between, "boot int, high long, low long, below long"))
        order = Window.partitionBy("boot").orderBy("high", "low")
        under = seen.groupBy("boot").agg(F.coalesce(F.sum("below"), F.lit(0)).alias("_under"))
        placed = seen.where("high IS NOT NULL").withColumn("_r", F.row_number().over(order)).join(under, "boot")
        last = {r["boot"]: (r["high"], r["low"]) for r in placed.where(F.col("_under") + F.col("_r") == min(keep, n)).select("boot", "high", "low").collect()}  # one row for each draw
        if len(last) == n_draws:
            break
        if lo == 0.0 and hi == 1.0:
            raise ValueError("clusters must be distinct")
        reach *= 8

    bound = np.array([last[b] for b in range(n_draws)], np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _CELLS // 1000):
                part = batch.slice(i, _CELLS // 1000)
                out = np.zeros((part.num_rows, n_draws), np.uint8)
                for rows, own, high, low in hashes(part.column("_t")):
                    first, second = bound[own, 0][:, None], bound[own, 1][:, None]
                    out[np.ix_(rows, own)] = ((high < first) | ((high == first) & (low <= second))).T
                yield pa.RecordBatch.from_arrays([part.column("_c"), pa.array([r.tobytes() for r in out], pa.binary())], names=[cluster, "_m"])

    return texts.mapInArrow(mark, f"`{cluster}` {kinds[cluster]}, _m binary")


def draw_table(draws: DataFrame, *, cluster: str, n_draws: int) -> DataFrame:
    """(boot, cluster, weight) from (cluster, _m)."""
    kind = dict(draws.dtypes)[cluster]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS // (8 * n_draws))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                m = _bytes_of(part.column("_m"), n_draws)
                row, boot = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(boot, pa.int32()), part.column("_c").take(pa.array(row)), pa.array(m[row, boot], pa.int64())], names=["boot", cluster, "weight"])

    return draws.select(F.col(cluster).alias("_c"), "_m").mapInArrow(listed, f"boot int, `{cluster}` {kind}, weight long")


def value_sums(rows: DataFrame, draws: DataFrame, *, cluster: str, values: Sequence[str], n_draws: int) -> DataFrame:
    """(boot, sums): the sums of numeric columns in every draw, added up inside the tasks."""
    joined = rows.join(draw_bytes(draws, cluster=cluster, n_draws=n_draws), cluster).select(F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values]).alias("_v"), "_m")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_draws, len(values)))
        for batch in batches:
            v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(values))
            m = _bytes_of(batch.column("_m"), n_draws)
            for i in range(0, len(v), 1024):
                sums += m[i : i + 1024].T.astype(np.float64) @ v[i : i + 1024]
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["_part"])

    summed = joined.mapInArrow(add, "_part array<double>").agg(vector_sum("_part").alias("_part"))
    at = summed.select("_part", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("boot"))
    return at.select("boot", F.slice("_part", F.col("boot") * len(values) + 1, len(values)).alias("sums"))


def draw_bytes(draws: DataFrame, *, cluster: str, n_draws: int) -> DataFrame:
    """(cluster, _m): a cluster's multiplicity in every draw, one byte each; ``draws`` has them already, or is a table (boot, cluster, weight)."""
    if "_m" in draws.columns:
        return draws
    lists = draws.groupBy(cluster).agg(F.collect_list(F.struct("boot", "weight")).alias("_p"))
    return lists.select(cluster, dense(n_draws)(F.col("_p.boot"), F.col("_p.weight").cast("array<double>")).alias("_m"))


def _bytes_of(column: pa.Array, n_draws: int) -> np.ndarray:
    """Multiplicities of the rows, one row each."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros((0, n_draws), np.uint8)
    first = int(np.frombuffer(where, wide, 1, column.offset * np.dtype(wide).itemsize)[0])
    return np.frombuffer(data, np.uint8, len(column) * n_draws, first).reshape(len(column), n_draws)


def cell_draws(cells: DataFrame, draws: DataFrame, *, cluster: str, keys: Sequence[str], n_draws: int) -> DataFrame:
    """(keys, boot, _w): the weight of every cell in every draw, summed over clusters inside the tasks."""
    keys = list(keys)
    rows = cells.join(draw_bytes(draws, cluster=cluster, n_draws=n_draws), cluster).select(*keys, F.col("_w").cast("double").alias("_w"), "_m")
    kinds = dict(rows.dtypes)
    names = pa.schema([(k, to_arrow_type(rows.schema[k].dataType)) for k in keys])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            found = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            m, w = _bytes_of(batch.column("_m"), n_draws), batch.column("_w").to_numpy()
            place = {key: i for i, key in enumerate(dict.fromkeys(found))}
            of = np.fromiter((place[key] for key in found), np.int64, len(found))
            step = max(1, _CELLS // n_draws)
            for i in range(0, len(found), step):
                hot = np.zeros((len(place), len(of[i : i + step])))
                hot[of[i : i + step], np.arange(hot.shape[1])] = w[i : i + step]
                part = hot @ m[i : i + step].astype(np.float64)
                for key, at in place.items():
                    sums[key] = sums[key] + part[at] if key in sums else part[at]
        for key, values in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], names.field(k).type) for k, v in zip(keys, key, strict=True)), pa.array([values], pa.list_(pa.float64()))], names=[*keys, "_part"])

    parts = rows.mapInArrow(add, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _part array<double>")
    summed = parts.groupBy(*keys).agg(vector_sum("_part").alias("_part"))
    return summed.select(*keys, F.posexplode("_part").alias("boot", "_w")).where("_w > 0")


class _Bucket:
    """Running sums of one (group, bucket)."""

    def __init__(self, key, n_draws: int):
        self.key, self.wins = key, np.zeros(n_draws)
        self.below, self.positive = np.zeros(n_draws), np.zeros(n_draws)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        running = np.cumsum(q, axis=0)
        q *= 0.5
        running -= q
        self.wins += np.einsum("ij,ij->j", p, running)
        running_last = running[-1] + q[-1]
        total = p.sum(0)
        self.wins += self.below * total
        self.below = self.below + running_last
        self.positive = self.positive + total


def _matrices(m: np.ndarray, w: np.ndarray, mode: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative weights of the rows in every draw."""
    weighed = m * w[:, None]
    if not (mode == SPLIT).any():
        positive = (mode != NEGATIVE)[:, None]
        return weighed * positive, weighed * ~positive
    p = np.where((mode != NEGATIVE)[:, None], weighed, 0.0)
    return p, np.where((mode == NEGATIVE)[:, None], weighed, np.where((mode == SPLIT)[:, None], w[:, None] - weighed, 0.0))


def auroc_by_draw(rows: DataFrame, *, keys: Sequence[str], score: str, n_draws: int) -> DataFrame:
    """(keys, draw, auroc) for rows with ``_w``, ``_mode`` and the bytes ``_m``, or the lists ``_draws`` and ``_counts``.

    ``_mode``: the multiplicities weigh a negative row, a positive row, or the positive share
    of a row whose remaining weight is negative.
    """
    keys = list(keys)
    if "_m" not in rows.columns:
        rows = rows.withColumn("_m", dense(n_draws)(F.col("_draws").cast("array<int>"), F.col("_counts").cast("array<double>")))
    cut = rows.where(F.col(score).isNotNull()).select(
        *keys, F.floor(value_bucket(score) / 128).alias("_b"), F.col(score).cast("double").alias("_s"), F.col("_w").cast("double").alias("_w"), "_mode", "_m"
    )
    ordered = cut.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", "_s")
    group = [*keys, "_b"]
    kinds = dict(cut.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in group) + ", p array<double>, q array<double>, u array<double>"

    names = pa.schema([(k, to_arrow_type(cut.schema[k].dataType)) for k in group] + [(c, pa.list_(pa.float64())) for c in "pqu"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS // n_draws)
        bucket, tie, tied, done = None, None, None, []  # tie: (key, score) still open at a chunk's end

        def add(key, p, q) -> None:
            nonlocal bucket
            if bucket is None or bucket.key != key:
                if bucket is not None:
                    done.append([*bucket.key, bucket.positive, bucket.below, bucket.wins])
                bucket = _Bucket(key, n_draws)
            bucket.add(p, q)

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(done) >= least:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(names)], schema=names)
                done.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                columns = [part.column(k).to_numpy(zero_copy_only=False) for k in group]
                scores = part.column("_s").to_numpy(zero_copy_only=False)
                turn = np.zeros(part.num_rows, dtype=bool)  # a new bucket starts here
                turn[0] = True
                for c in columns:
                    turn[1:] |= c[1:] != c[:-1]
                fresh = turn.copy()
                fresh[1:] |= scores[1:] != scores[:-1]
                first = np.flatnonzero(fresh)
                p, q = _matrices(_bytes_of(part.column("_m"), n_draws), part.column("_w").to_numpy(), part.column("_mode").to_numpy())
                if len(first) < part.num_rows:
                    p, q = np.add.reduceat(p, first, axis=0), np.add.reduceat(q, first, axis=0)

                def key_at(row: int) -> tuple:
                    return tuple(c[row] for c in columns)

                if tie is not None:
                    if tie == (key_at(0), scores[0]):
                        p[0] += tied[0]
                        q[0] += tied[1]
                    else:
                        add(tie[0], tied[0][None, :], tied[1][None, :])
                last = len(first) - 1  # whole ties go in, one run per bucket; the last tie stays open
                edges = [*np.flatnonzero(turn[first]).tolist(), last]
                for at, end in zip(edges, edges[1:]):
                    if at < min(end, last):
                        add(key_at(first[at]), p[at : min(end, last)], q[at : min(end, last)])
                tie, tied = (key_at(first[last]), scores[first[last]]), (p[last], q[last])
            yield from flush(256)
        if tie is not None:
            add(tie[0], tied[0][None, :], tied[1][None, :])
        if bucket is not None:
            done.append([*bucket.key, bucket.positive, bucket.below, bucket.wins])
        yield from flush(1)

    long = ordered.mapInArrow(scan, shape).select(*group, F.posexplode(F.arrays_zip("p", "q", "u")).alias("draw", "_z"))
    long = long.select(*group, "draw", F.col("_z.p").alias("p"), F.col("_z.q").alias("q"), F.col("_z.u").alias("u"))
    lower = Window.partitionBy(*keys, "draw").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a group's buckets
    stacked = long.withColumn("_q", F.coalesce(F.sum("q").over(lower), F.lit(0.0)))
    g = stacked.groupBy(*keys, "draw").agg(F.sum("p").alias("_P"), F.sum("q").alias("_Q"), F.sum(F.col("u") + F.col("p") * F.col("_q")).alias("_u"))
    return g.select(*keys, "draw", F.when((F.col("_P") > 0) & (F.col("_Q") > 0), F.col("_u") / (F.col("_P") * F.col("_Q"))).alias("auroc"))


def weighted_rows(cells: DataFrame, draws: DataFrame, *, cluster: str, target: str, n_draws: int) -> DataFrame:
    """Cells with the multiplicities of their cluster; a cluster that no draw picked adds nothing."""
    return cells.join(draw_bytes(draws, cluster=cluster, n_draws=n_draws), cluster).withColumn(
        "_mode", F.when(F.col(target) == 1, POSITIVE).otherwise(NEGATIVE)
    )


def permuted_rows(rows: DataFrame, drawn: DataFrame, *, unit: str, label: str, classes: Sequence, proba: str, keep: Sequence[str]) -> DataFrame:
    """One-vs-rest rows whose target differs by permutation: the list holds the draws in which it is positive."""
    lists = drawn.groupBy(unit, F.col(label).cast("string").alias("cls")).agg(F.collect_list("perm").alias("_draws"))
    spots = [F.struct(F.lit(str(c)).alias("cls"), F.get(proba, F.lit(i)).alias("score")) for i, c in enumerate(classes)]
    long = rows.select(unit, *keep, F.explode(F.array(*spots)).alias("_e")).select(unit, *keep, "_e.*")
    none = F.array().cast("array<int>")
    j = long.join(lists, [unit, "cls"], "left").withColumn("_draws", F.coalesce("_draws", none))
    return j.withColumns({"_counts": F.transform("_draws", lambda d: F.lit(1.0)), "_w": F.lit(1.0), "_mode": F.lit(SPLIT)})
