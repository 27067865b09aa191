"""Byte-level BPE by ranks: a two-tier look-up, and decoding.

Tier one is a minimal perfect hash over the vocabulary: it gives every byte
string one slot of exactly as many slots as tokens, and the slot's own string
decides whether the pre-token is a token. Tier two merges what is left: the
bytes are a linked list, a heap holds adjacent pairs by (rank, position), and
stale entries are skipped, so a pre-token of n bytes costs n log n.

Null texts count as empty; an empty text has no ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import filled, sized, sized_batches, splitmix, stream
from kinfold.llm.pieces import UnitCache

_BYTE = stream(256, 3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def _hashes(strings: list[bytes]) -> np.ndarray:
    length = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(begin, length)
    power = np.full(int(length.max(initial=1)), np.uint64(0xD1342543DE82EF95))
    power[0] = 1
    values = np.append(_BYTE[data] * np.cumprod(power)[place], np.uint64(0))
    return splitmix(np.where(length > 0, np.add.reduceat(values, begin), np.uint64(0)) + length.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash by displacement: a bucket of keys shares one displacement that sends all to free slots."""

    KEYS_PER_BUCKET = 4

    def __init__(self, keys: list[bytes]) -> None:
        self.n = np.uint64(len(keys))
        self.buckets = np.uint64(max(1, len(keys) // self.KEYS_PER_BUCKET))
        hashes = _hashes(keys)
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("two keys share a 64-bit hash")
        bucket = (hashes % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=int(self.buckets))
        begin = np.cumsum(count) - count
        self.shift = np.zeros(int(self.buckets), np.int64)
        self.slot_key = np.full(len(keys), -1, np.int64)
        for b in np.argsort(-count, kind="stable"):
            own = order[begin[b] : begin[b] + count[b]]
            if len(own) == 1:
                break
            if not len(own):
                return
            tried = 0
            while True:
                shifts = np.arange(tried, tried + 256)
                slots = self._place(hashes[own][None, :], shifts[:, None])
                free = (self.slot_key[slots] < 0).all(1)
                sure = np.sort(slots, 1)
                free &= (sure[:, 1:] != sure[:, :-1]).all(1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b], self.slot_key[slots[k]] = shifts[k], own
                    break
                tried += 256
        single = np.flatnonzero(count == 1)  # a bucket of one key names a free slot itself
        left = np.flatnonzero(self.slot_key < 0)
        self.shift[single] = -1 - left[: len(single)]
        self.slot_key[left[: len(single)]] = order[begin[single]]

    def _place(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (splitmix(hashes + shift.astype(np.uint64) * _MIX) % self.n).astype(np.int64)

    def candidates(self, strings: list[bytes]) -> np.ndarray:
        """For each string the number of the only key that it can equal."""
        hashes = _hashes(strings)
        shift = self.shift[(hashes % self.buckets).astype(np.int64)]
        return self.slot_key[np.where(shift < 0, -1 - shift, self._place(hashes, shift))]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a pre-token: always the pair of least rank, the first of equals, until none is a token."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        mid = after[i]
        if mid < 0 or mid >= n or after[mid] != end:
            continue
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            stop = after[end]
            if (r := ranks.get(piece[i:stop])) is not None:
                heappush(heap, (r, i, stop))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = read_ranks(path)
        self.tokens = list(self.ranks)
        self.rank_of = np.array([self.ranks[t] for t in self.tokens], np.uint32)
        self.table = PerfectHash(self.tokens)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.cached = UnitCache(self._encode_units)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """ids of each pre-token as little-endian 32-bit words."""
        if not pieces:
            return []
        tokens, rank_of, ranks = self.tokens, self.rank_of, self.ranks
        return [
            rank_of[k].tobytes() if k >= 0 and tokens[k] == p else np.array(merge(p, ranks), np.uint32).tobytes()
            for p, k in zip(pieces, self.table.candidates(pieces).tolist(), strict=True)
        ]

    def _encode_units(self, texts: list[str]) -> list[bytes]:
        found = [[p.encode() for p in self.pattern.findall(t)] for t in texts]
        distinct = list({p for pieces in found for p in pieces})
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint32) for b in self.cached.ids(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@cache
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column as array<int>."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for texts in batches:
            found = [x for part in sized(texts) for x in own.encode(filled(part).to_pylist())]
            edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))

    return docs.withColumn(ids, encoded(F.col(column)))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with the bytes that their ids stand for."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for lists in batches:
            yield pa.array([own.decode(np.asarray(x.values)) if x.is_valid else b"" for x in lists], pa.binary())

    return rows.withColumn(out, decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, both digested where they are made."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = {r: str(r) for r in own.bytes_of}
        for batch in sized_batches(batches, "text"):
            found = own.encode(filled(batch.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in found], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
