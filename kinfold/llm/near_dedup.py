"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of 5-word shingles (64-bit hashes), every distinct
   set one signature of ``BANDS * ROWS`` minima. Rows with the same set are one class from here on.
2. Classes that share a band's minima are candidates. A bucket never yields all its
   pairs: first each member is paired with the bucket's smallest id.
3. Signatures of a candidate pair are compared a batch at a time; the pair goes as
   soon as the posterior of "similarity >= threshold" falls below ``MISS``. Survivors are
   confirmed on the full sets.
4. Buckets whose members are not all connected by then are gathered by their smallest id, with the
   full sets. A task holds two blocks of such a group, counts all its intersections as
   a product of 0/1 matrices, and returns only the links that join components, so
   what comes out is smaller than what went in, whatever the size of the group.

A banded pair at exactly 0.75 escapes all bands with a chance of 3e-7; the pairs
dropped in step 3 have a posterior below 1e-7 each. Null and empty texts have an empty set
and are linked with nothing; repeated rows share their component. Classes are numbered, so rows
link by their texts whatever ids they share or lack. ``component_id`` and ``kept`` tell by id: a row without
a ``doc_id`` has no name there, so its ``component_id`` is null and ``kept`` true; :func:`keepers` tells by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import binaries, row_key, sized_batches, splitmix, stream
from kinfold.llm.components import components
from kinfold.llm.words import hashed_words
from kinfold.session import durable

WORDS = 5
#: A similarity of at least ``PERCENT`` hundredths links.
PERCENT = 75
BANDS, ROWS = 40, 4
#: Signature entries compared between two looks at the posterior, and the chance of dropping a link there.
BATCH, MISS = 16, 1e-7
#: Members of one block of a group, and shingles of all its members together (a single longer one is a block of its own).
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Ids up to this many are sent to the scan of the texts; more are joined with them by a shuffle.
SENT_IDS = 500_000

_K = BANDS * ROWS
_A = (stream(_K, 4) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (stream(_K, 5) >> np.uint64(32)).astype(np.uint32)
_ORDER = stream(WORDS, 6) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than five make one shingle."""
    words, first = hashed_words(texts)
    n = len(words)
    if n >= WORDS:
        rolled = np.zeros(n - WORDS + 1, np.uint64)
        for k in range(WORDS):
            rolled += splitmix(words[k : n - WORDS + 1 + k] * _ORDER[k])
        rolled = splitmix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = sum((splitmix(words[a + k : a + k + 1] * _ORDER[k]) for k in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(splitmix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(_K, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * _A + _B).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_hash, signature), one row per row of ``docs``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "row_key", "n_shingles", "set_hash", "signature"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row_key"), "text")
    return keyed.mapInArrow(make, "doc_id long, row_key string, n_shingles long, set_hash binary, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """(id, key): one key per band."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = stream(ROWS, 8) | np.uint64(1)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
                key = splitmix((splitmix(sig.astype(np.uint64) + np.uint64(1)) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), BANDS)), pa.array(key.view(np.int64).ravel())], names=["id", "key"])

    return classes.select("id", "signature").mapInArrow(cut, "id long, key long")


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Fewest matching entries after 16, 32, ... that leave P(similarity >= threshold | matches) at ``miss`` or more.

    The prior is uniform, so the posterior after m of n matches is Beta(m + 1, n - m + 1),
    whose upper tail is a binomial sum: P(s >= t) = P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, _K + 1, BATCH):
        k = np.arange(n + 2)
        log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 2)))])
        tail = np.cumsum(np.exp(log[n + 1] - log[k] - log[n + 1 - k] + k * np.log(t) + (n + 1 - k) * np.log1p(-t)))
        out.append(int(np.argmax(tail >= miss)))
    return np.array(out)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs (a, b) whose signatures survive the sequential test."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = least_matches(percent)
        for batch in batches:
            for start in range(0, len(batch), 4000):
                part = batch.slice(start, 4000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, _K) for c in ("sig_a", "sig_b"))
                alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
                for i, floor in enumerate(floors):
                    s = slice(i * BATCH, (i + 1) * BATCH)
                    matches[alive] += (a[alive, s] == b[alive, s]).sum(axis=1)
                    alive = alive[matches[alive] >= floor]
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a long, b long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles): the full sets of the ``rows`` (name, text) that ``wanted`` (name, id) names, as sorted little-endian words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), binaries(np.array([8 * len(s) for s in sets]), np.concatenate(sets).view(np.uint8))], names=["id", "shingles"])

    wanted = durable(wanted)
    if wanted.limit(SENT_IDS + 1).count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "name").select("id", "text").mapInArrow(make, "id long, shingles binary").dropDuplicates(["id"])


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the named documents."""
    return _sets(docs.select(F.col("doc_id").cast("long").alias("name"), "text"), ids.select("id", F.col("id").alias("name")).distinct())


def class_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, shingles) of the named classes, from the text of each one's first row."""
    wanted = ids.select("id").distinct().join(classes.select("id", F.col("least.row_key").alias("name")), "id")
    return _sets(docs.select(row_key(docs).alias("name"), "text"), wanted)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) with ``100 * |A and B| >= percent * |A or B|`` on the full sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(test, "a long, b long")


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket (id, key) with the bucket's smallest id."""
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("_most")).where("head < _most").select("key", "head")
    return members.join(heads, "key").where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()


def open_groups(members: DataFrame, labels: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(head, id, component, blocks) of the buckets whose members are not all connected, gathered by smallest id."""
    known = members.join(labels, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    still = known.groupBy("key").agg(F.min("id").alias("head"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key", "head")
    grouped = durable(known.join(still, "key").select("head", "id", "component").distinct())
    sized = grouped.join(classes.select("id", "n_shingles"), "id").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / BLOCK_SHINGLES)).alias("blocks")
    return grouped.join(durable(sized.select("head", blocks)), "head")  # apart, so that the join can split a large group


def bridges(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between members of different components, only as many as connect what is linked."""
    names, component = np.unique(component, return_inverse=True)
    if len(names) < 2:
        return []
    odd = np.flatnonzero(component != np.bincount(component).argmax())
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    columns, width = int(column[-1]) + 1 if len(column) else 0, 1024
    head, out = np.arange(len(names)), []
    for strip in np.split(odd, range(256, len(odd), 256)):
        both = np.zeros((len(strip), len(sets)), np.float32)  # exact: whole numbers below 2 ** 24
        for low in range(0, columns, width):
            part = slice(*np.searchsorted(column, [low, low + width]))
            matrix = np.zeros((len(sets), width), np.float32)
            matrix[owner[part], column[part] - low] = 1
            both += matrix[strip] @ matrix.T
        both = both.astype(np.float64)
        apart = component[strip, None] != component[None, :]
        x, y = np.nonzero(apart & (100 * both >= percent * (size[strip, None] + size[None, :] - both)))
        x = strip[x]
        _, first = np.unique(component[x] * len(names) + component[y], return_index=True)
        for a, b in zip(x[first].tolist(), y[first].tolist(), strict=True):
            p, q = int(component[a]), int(component[b])
            while head[p] != p:
                p = int(head[p])
            while head[q] != q:
                q = int(head[q])
            if p != q:
                head[max(p, q)] = min(p, q)
                out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
    return out


def group_links(groups: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the links that join components within each group; blocks of a large group meet two by two."""
    blocks = F.col("blocks").cast("long")
    own = F.pmod(F.xxhash64("id", F.lit(13)), blocks).alias("own")
    dealt = groups.select("head", "id", "component", own, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    placed = dealt.select("id", "head", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def resolve(group: pa.Table) -> pa.Table:
        sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("shingles")]
        found = bridges(group.column("id").to_numpy(), group.column("component").to_numpy(), sets_, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return placed.join(sets, "id").groupBy("head", "i", "j").applyInArrow(resolve, "a long, b long")


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows, the classes (id, set_hash, least, ...), the component of each linked class, and each component's least row.

    Classes are numbered in the order of their least rows, so that a bucket's head is its least document.
    """
    rows = durable(signatures(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key")).alias("least")
    grouped = rows.where("n_shingles > 0").groupBy("set_hash").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = durable(grouped.repartitionByRange("least").sortWithinPartitions("least").withColumn("id", F.monotonically_increasing_id()))
    keys = bands(classes)
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    members = durable(keys.join(crowded, "key").select("id", "key"))
    links = durable(_links(docs, star_pairs(members), classes, percent))
    labels = components(links)

    opened = durable(open_groups(members, labels, classes))
    more = group_links(opened, class_sets(docs, opened, classes), percent)
    labels = components(durable(links.unionByName(more)))
    heads = durable(labels.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("best")))
    return rows, classes, labels, heads


def keepers(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row_key): the least row of each group of near duplicates, and every row that is linked with nothing."""
    rows, classes, labels, heads = _linked(docs, percent)
    alone = classes.join(labels, "id", "left_anti").select("least.row_key")
    return heads.select("best.row_key").unionByName(alone).unionByName(rows.where("n_shingles = 0").select("row_key"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    rows, classes, labels, heads = _linked(docs, percent)
    linked = durable(labels.join(heads, "component").select("id", "best"))
    class_of = durable(classes.join(linked, "id", "left").select("set_hash", F.coalesce("best.doc_id", "least.doc_id").alias("component_id")))
    joined = rows.join(class_of, "set_hash", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(True)).alias("kept"))


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that are links."""
    left = durable(plausible(pairs, classes, percent))
    return confirmed(left, class_sets(docs, left.select(F.explode(F.array("a", "b")).alias("id")), classes), percent)
