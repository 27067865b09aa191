"""Repeated 200-byte strings, removed.

**Anchors.** A string of ``LENGTH`` bytes has one anchor: the least hash among its
``GRAM``-byte grams, the leftmost of equals. Equal strings have equal anchors at equal
places, so only strings of one anchor need comparing. Each run of starts with the
same anchor is an occurrence, its context is the bytes that the strings of
the run cover. Occurrences are counted by anchor and by context (a hash of the context's
bytes); anchors that occur once are done.

**Suffix arrays.** One copy of each distinct context of a repeated anchor, with the number
of its occurrences, goes to a task with all others of that anchor. A task lays its
contexts end to end and builds a suffix array of their starts by two-stage
sorting: starts whose suffix is smaller than its successor are sorted directly, to the
depth that matters; the others follow from a scan of the buckets, each placed at the head of its
first byte's bucket when its successor is met. Neighbours in the array whose common
prefix is ``LENGTH`` or more hold the same string.

An anchor with more than ``CROWD`` distinct contexts would make one task large: its
strings are counted one by one by their 128-bit fingerprints instead, merged before
the shuffle. Both ways give the same marks.

Null texts count as empty. Rows that repeat (same ``doc_id`` and text) count as
different documents, so all their strings are removed, and each has its row; a null
``doc_id`` is a document like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import binaries, packed, sized_batches, splitmix, stream
from kinfold.session import durable

LENGTH = 200
GRAM = 32
CROWD = 10_000

_BYTE = stream(256, 9)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each position on."""
    h = _BYTE[data]
    span, base = 1, 0x9FB21C651E98DF25
    while span < gram:
        h = h[:-span] * np.uint64(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
    return splitmix(h)


def _least_places(order: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` the place of its least value, the leftmost of equals."""
    n = len(order)
    keys = (order & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max)
    grid[:n] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    return (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def occurrences(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, place, first, last) of every run of starts with one anchor; places count from ``data``'s begin."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    hashes = gram_hashes(data, gram)
    places = _least_places(hashes, length - gram + 1)
    starts = np.arange(len(places))
    text = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[text + 1]
    starts, places, text = starts[inside], places[inside], text[inside]
    new = np.ones(len(starts), bool)
    new[1:] = (places[1:] != places[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    if not len(begin):
        end = begin
    return text[begin], hashes[places[begin]], places[begin], starts[begin], starts[end]


def suffix_order(text: bytes, begin: list[int], last: list[int], end: list[int]) -> np.ndarray:
    """All starts ``begin..last`` of every context in the order of their suffixes, by two-stage sorting.

    Context c is ``text[begin[c]:end[c]]``; one byte stands between contexts. A context's end
    counts as smaller than any byte, ends in the order of the contexts.
    """
    data = np.frombuffer(text, np.uint8).astype(np.int16)
    n = len(data)
    smaller = np.zeros(n, bool)  # the suffix is smaller than its successor
    differs = np.zeros(n, bool)
    differs[:-1] = data[:-1] != data[1:]
    ends = np.array(end) - 1
    differs[ends] = True  # an end is smaller than any byte, so the last suffix is the larger one
    up = np.zeros(n, bool)
    up[:-1] = data[:-1] < data[1:]
    up[ends] = False
    decides = np.minimum.accumulate(np.where(differs, np.arange(n), n - 1)[::-1])[::-1]  # where an equal run ends
    smaller = up[decides]
    place = np.arange(n)
    next_small = np.minimum.accumulate(np.where(smaller, place, n)[::-1])[::-1]
    begin_, last_ = np.array(begin), np.array(last)
    reach = np.minimum(next_small[last_], ends)  # starts, and what follows until a directly sorted suffix
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begin_, 1)
    np.add.at(edge, reach + 1, -1)
    wanted = np.cumsum(edge[:-1]) > 0

    direct = np.flatnonzero(wanted & smaller)
    stop = np.array(end)[np.searchsorted(begin_, direct, "right") - 1]
    keys = [text[p:e] for p, e in zip(direct.tolist(), stop.tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]

    induced = wanted & ~smaller
    larger = np.bincount(data[induced], minlength=256)
    both = larger + np.bincount(data[direct], minlength=256)
    head = np.cumsum(both) - both
    order = np.full(int(both.sum()), -1, np.int64)
    firsts = data[direct]
    order[(head + larger)[firsts] + np.arange(len(direct)) - np.searchsorted(firsts, firsts)] = direct
    out, heads, flag, letters = order.tolist(), head.tolist(), induced.tobytes(), text
    for p in [e - 1 for e in end if flag[e - 1]]:
        c = letters[p]
        out[heads[c]] = p
        heads[c] += 1
    for p in out:  # an entry is filled before the scan meets it
        q = p - 1
        if q >= 0 and flag[q]:
            c = letters[q]
            out[heads[c]] = q
            heads[c] += 1
    order = np.array(out, np.int64)
    return order[order <= last_[np.searchsorted(begin_, order, "right") - 1]]


def common_prefixes(text: bytes, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix in order the bytes it shares with the one before, counted in whole words up to ``length``."""
    size = next(w for w in (8, 4, 2, 1) if length % w == 0)
    words = np.ndarray(len(text) - size + 1, f"<u{size}", text, strides=(1,))
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(0, length, size):
        alive = alive[words[order[alive] + k] == words[order[alive - 1] + k]]
        out[alive] = k + size
    return out


def repeated_starts(contexts: list[bytes], times: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context which of its starts hold a string that occurs at least twice; ``times``: occurrences of each context."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    last, end = begin + sizes - length, begin + sizes
    text = b"\0".join([*contexts, b""])
    order = suffix_order(text, begin.tolist(), last.tolist(), end.tolist())
    group = np.cumsum(common_prefixes(text, order, length) < length) - 1
    owner = np.searchsorted(begin, order, "right") - 1
    many = np.bincount(group, times[owner]) >= 2
    marked = np.zeros(len(text), bool)
    marked[order[many[group]]] = True
    return [marked[b : x + 1] for b, x in zip(begin.tolist(), last.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[int]:
    """first, last, first, last, ... of the true stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    edges[1::2] -= 1
    return edges.tolist()


#: Stands for a null id.
_NO_ID = -(1 << 63)
_AT = "id long, row_key long"


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """(id, row_key, anchor, context, first, last) of every occurrence."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            data, offsets = packed(batch.column("text"))
            text, anchor, _, first, last = occurrences(data, offsets, length)
            raw = data.tobytes()
            context = [xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(text)) for c in ("id", "row_key")),
                    pa.array(anchor.view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64)),
                    *(pa.array((x - offsets[text]).astype(np.int32)) for x in (first, last)),
                ],
                names=["id", "row_key", "anchor", "context", "first", "last"],
            )

    return docs.mapInArrow(find, f"{_AT}, anchor long, context long, first int, last int")


def _contexts(docs: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """(anchor, context, times, crowded, body): the bytes of one copy of each context."""
    wanted = copies.groupBy("id", "row_key").agg(F.collect_list(F.struct("anchor", "context", "times", "crowded", "first", "last")).alias("parts"))
    schema = "anchor long, context long, times long, crowded boolean, body binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            data, offsets = packed(batch.column("text"))
            raw, lists = data.tobytes(), batch.column("parts")
            parts, whose = lists.flatten(), np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            first, last = (parts.field(c).to_numpy() + offsets[whose] for c in ("first", "last"))
            body = [raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(parts.field(c) for c in ("anchor", "context", "times", "crowded")), pa.array(body, pa.binary())], names=["anchor", "context", "times", "crowded", "body"])

    return docs.join(wanted, ["id", "row_key"]).select("id", "row_key", "text", "parts").mapInArrow(cut, schema)


_RUNS = "anchor long, context long, runs array<int>"


def _by_suffix_array(contexts: DataFrame, length: int, block: int = 1 << 20) -> DataFrame:
    """(anchor, context, runs): repeated starts of each context; a task takes whole anchors, about ``block`` bytes at a time."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            marks = repeated_starts([h[3] for h in held], np.array([h[2] for h in held], np.float64), length)
            found = [(h[0], h[1], _runs(m)) for h, m in zip(held, marks, strict=True) if m.any()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["anchor", "context", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "times", "body")), strict=True):
                if size >= block and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                if held and held[-1][:2] == row[:2]:  # a repeated row names the same copy twice
                    continue
                held.append(row)
                size += len(row[3])
        if held:
            yield done()

    rows = contexts.select("anchor", "context", "times", "body").repartition("anchor").sortWithinPartitions("anchor", "context")
    return rows.mapInArrow(solve, _RUNS)


def _by_fingerprint(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, runs) of crowded anchors, each string counted by itself."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "times", "body")), strict=True):
                n = len(row[3]) - length + 1
                prints = [xxhash.xxh3_128_digest(row[3][i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in row[:3]] + [pa.array(range(n), pa.int32()), pa.array(prints, pa.binary())], names=["anchor", "context", "times", "at", "print"])

    copies = contexts.dropDuplicates(["anchor", "context"])
    strings = copies.mapInArrow(spread, "anchor long, context long, times long, at int, print binary")
    many = strings.groupBy("print").agg(F.sum("times").alias("n")).where("n >= 2").select("print")
    return strings.join(many, "print").groupBy("anchor", "context").agg(F.flatten(F.collect_list(F.array("at", "at"))).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(id, row_key, parts): starts of repeated strings of each row, as a list of (first, last)."""
    found = _anchored(docs, length)
    often = durable(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))  # apart, so that the join can split a hot anchor
    seen = durable(found.join(often, "anchor").select("id", "row_key", "anchor", "context", "first", "last"))
    one = F.min(F.struct("id", "row_key", "first", "last"))
    copies = seen.groupBy("anchor", "context").agg(one.alias("one"), F.count(F.lit(1)).alias("times"))
    copies = durable(copies.select("anchor", "context", "times", "one.*"))
    full = durable(copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("anchor", F.lit(True).alias("_full")))
    crowded = not full.isEmpty()
    copies = copies.join(full, "anchor", "left").withColumn("crowded", F.col("_full").isNotNull()).drop("_full") if crowded else copies.withColumn("crowded", F.lit(False))
    contexts = _contexts(docs, copies, length)
    runs = _by_suffix_array(contexts.where("not crowded"), length)
    if crowded:
        runs = runs.unionByName(_by_fingerprint(contexts.where("crowded"), length))
    return seen.join(runs, ["anchor", "context"]).groupBy("id", "row_key").agg(F.collect_set(F.struct("first", "runs")).alias("parts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), with ``with_text`` also ``kept`` (binary): one row per row of ``docs``."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    keyed = docs.select(id_.alias("id"), F.coalesce("text", F.lit("")).alias("text")).select("id", F.xxhash64("id", "text").alias("row_key"), "text")
    spans = repeated_spans(keyed, length, crowd)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            rows = []
            for text, parts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("parts").to_pylist(), strict=True):
                edge = np.zeros(len(text) + 1, np.int32)
                for part in parts or ():
                    runs = np.array(part["runs"]) + part["first"]
                    np.add.at(edge, runs[0::2], 1)
                    np.add.at(edge, runs[1::2] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if parts else text
                rows.append((len(text), int(gone.sum()), len(_runs(gone)) // 2, hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", *names])

    # both joins of the texts read these three columns alike, so the texts are shuffled once
    removed = keyed.join(spans, ["id", "row_key"], "left").select("id", "row_key", "text", "parts").mapInArrow(remove, schema)
    return removed.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
