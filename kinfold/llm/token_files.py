"""Token ids as Arrow stream files of fixed-size sequences.

Documents are ordered by id over ranges; a task encodes its range with the
tokenizers library (whole texts, cut only where the vocabulary always cuts), ends each document with an
end id, and writes the ids end to end as one Arrow IPC stream of record batches:
``ids`` is a fixed-size list of ``SEQUENCE`` 16- or 32-bit integers, ``mask`` a fixed-size list
of as many bits. Only the last sequence of a file is padded (mask 0). All batches
but the last hold ``BATCH`` sequences and are equally long, so the bytes of
sequence k of a mapped file lie at a computed place: reading it copies nothing.

A file is written as a draft and then renamed, under a name of its own for each attempt: a task that runs
twice leaves a second whole file, which no one names. The manifest has one row per file that counts, with its documents
and their lengths; together with the file it gives every document's ids back.

Null texts count as empty: such a document is its end id alone. Null ids come first; rows with
the same id are ordered by a hash of their text.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import filled, shared_folder, sized_batches
from kinfold.llm.pieces import units
from kinfold.session import durable

SEQUENCE = 1024
BATCH = 256
#: Ids of one file, and bytes of text that a task encodes at once.
FILE_IDS, SLICE = 1 << 26, 4 << 20



#: White space before a space; where it occurs the plain cut at spaces does not hold. More characters than Python's ``\\s`` do no harm.
_RUN = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}] "
#: Units that one call of the library encodes, and units whose ids a worker keeps.
CALL, KEPT = 500, 2_000_000


def _cut(texts: pa.Array) -> pa.Array:
    """The units of every text: the first one whole, the later ones without the space each begins with."""
    odd = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
    if not odd.any():
        return pc.split_pattern(texts, " ")
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    exact = pa.array([[first, *rest] for first, rest in map(units, texts.filter(pa.array(odd)).to_pylist())], plain.type)
    order = np.empty(len(texts), np.int64)
    order[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
    return pa.concat_arrays([plain, exact]).take(pa.array(order))


class Tokenizer:
    """The library's tokenizer behind a bounded store of units and their ids.

    A slice of texts is cut and numbered by its distinct units inside Arrow; only units that are new to the worker reach
    the library, and the ids of the slice are gathered from the store at once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.wide = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.mark = plain[0] if plain else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.lengths, self.starts = np.zeros(0, self.wide), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _encoded(self, units: list[str], before: str, joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, ``before`` put before each, and how many each has.

        ``joined``: no unit holds an added token, so many meet in one string with a special token between them, which the library always cuts out whole.
        """
        if not joined:
            each = [np.array(e.ids, self.wide) for e in self.library.encode_batch_fast([before + u for u in units], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.wide), *each]), np.array([len(x) for x in each], np.int64)
        flat, sizes = [np.zeros(0, self.wide)], [np.zeros(0, np.int64)]
        for i in range(0, len(units), CALL):
            text = before + (self.mark[1] + before).join(units[i : i + CALL])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.wide)
            cut = ids == self.mark[0]
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1)
            flat.append(ids[~cut])
        return np.concatenate(flat), np.concatenate(sizes)

    def _numbers(self, units: list[str], joined: bool) -> np.ndarray:
        """Where the store has each of the (distinct) units, a space before it; new ones are added."""
        if len(self.known) + len(units) > KEPT:
            self._forget()
        known = self.known
        fresh = [u for u in units if u not in known]
        if fresh:
            flat, sizes = self._encoded(fresh, " ", joined)
            known.update(zip(fresh, range(len(self.lengths), len(self.lengths) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, sizes.astype(np.int32)])
            self.pool = np.concatenate([self.pool, flat])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id, and how many each text has."""
        n = len(texts)
        if not n:
            return np.zeros(0, self.wide), np.zeros(0, np.int64)
        joined = self.mark is not None and not any(pc.any(pc.match_substring(texts, c)).as_py() for c in self.added)
        cut = _cut(texts)
        flat, counts = cut.flatten(), cut.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts
        later = np.ones(len(flat), bool)
        later[first] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist(), joined)[coded.indices.to_numpy()]
        heads, head_sizes = self._encoded(flat.take(pa.array(first)).to_pylist(), "", joined)
        sizes, starts = np.empty(len(flat), np.int32), np.empty(len(flat), np.int32)
        sizes[later], starts[later] = self.lengths[number], self.starts[number]
        sizes[first], starts[first] = head_sizes, len(self.pool) + np.cumsum(head_sizes) - head_sizes
        of_text = np.add.reduceat(sizes, first, dtype=np.int64)
        ids = np.full(int(of_text.sum()) + n, end_id, self.wide)
        kept = np.ones(len(ids), bool)
        kept[np.cumsum(of_text + 1) - 1] = False
        shift = np.repeat(starts - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        ids[kept] = np.concatenate([self.pool, heads])[np.arange(len(shift), dtype=np.int32) + shift]
        return ids, of_text + 1


@cache
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _schema(wide: type, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(wide), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class Writer:
    """Collects ids and writes full batches; the padded rest at the end."""

    def __init__(self, sink, wide: type, sequence: int, batch: int) -> None:
        self.schema, self.wide, self.sequence, self.batch = _schema(wide, sequence), wide, sequence, batch
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def _put(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.sequence * self.batch
        if self.size >= full:
            flat = np.concatenate(self.held)
            for i in range(0, self.size - full + 1, full):
                self._put(flat[i : i + full], full)
            rest = flat[self.size // full * full :].copy()
            self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            self._put(np.concatenate([flat, np.zeros(-len(flat) % self.sequence, self.wide)]), len(flat))
        self.stream.close()


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None, sequence: int = SEQUENCE, batch: int = BATCH, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files; returns the manifest (part, file, n_ids, doc_ids, lengths), which is kept, so they are written once.

    A task begins a new file, and a new row of the manifest, after ``file_ids`` ids.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, store_, files = tokenizer(path), open_store(folder), 0
        writer = None
        for rows in sized_batches(batches, "text", SLICE):
            if writer is None:
                writer = _File(store_, folder, own.wide, sequence, batch)
            ids, lengths = own.encode(filled(rows.column("text")), end_id)
            writer.add(ids, rows.column("doc_id"), lengths)
            if writer.size >= file_ids:
                yield writer.close((TaskContext.get().partitionId() << 24) + files)
                writer, files = None, files + 1
        if writer is not None:
            yield writer.close((TaskContext.get().partitionId() << 24) + files)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))  # an id that many rows share is several ranges
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return durable(ordered.mapInArrow(write, "part long, file string, n_ids long, doc_ids array<long>, lengths array<long>"))


class _File:
    """One file being written, with what the manifest says of it."""

    def __init__(self, store: tuple[pafs.FileSystem, str], folder: str, wide: type, sequence: int, batch: int) -> None:
        self.store, self.place = store
        self.store.create_dir(self.place)
        self.name, self.folder = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrows", folder
        self.sink = self.store.open_output_stream(f"{self.place}/.{self.name}")
        self.writer = Writer(self.sink, wide, sequence, batch)
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> None:
        self.writer.add(ids)
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths)
        self.size += len(ids)

    def close(self, part: int) -> pa.RecordBatch:
        self.writer.close()
        self.sink.close()
        self.store.move(f"{self.place}/.{self.name}", f"{self.place}/{self.name}")
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.int64())) for x in (pa.concat_arrays(self.doc_ids), pa.array(np.concatenate(self.lengths)))]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{self.folder}/{self.name}"]), pa.array([self.size], pa.int64()), *lists], names=["part", "file", "n_ids", "doc_ids", "lengths"])


class TokenFile:
    """Random access to the sequences of one file; a local file is mapped, and what is returned are views of it."""

    def __init__(self, uri: str) -> None:
        store, place = open_store(uri)
        source = pa.memory_map(place) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(place)
        with pa.ipc.open_stream(source) as stream:
            self.batches = list(stream)
        self.rows = self.batches[0].num_rows if self.batches else 1

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch, row = self.batches[k // self.rows], k % self.rows
        ids, mask = (batch.column(c)[row].values for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def all_ids(self) -> Iterator[np.ndarray]:
        """The ids of each batch, without padding."""
        for k, batch in enumerate(self.batches):
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
            if k + 1 == len(self.batches):
                ids = ids[: batch.column("mask").flatten().true_count]
            yield ids


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids as binary of little-endian 32-bit words), every document read back from its file."""
    return _read(manifest, lambda ids: (ids.astype("<u4").tobytes(),), [("ids", pa.binary())], "ids binary")


def token_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), every document read back from its file."""
    digest = lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    return _read(manifest, digest, [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())], "n_tokens long, ids_crc32 long")


def _read(manifest: DataFrame, of, fields: list, schema: str) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", "n_ids").select(F.col("part").alias("_part"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))  # one row per file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream, held, at = TokenFile(row["file"]).all_ids(), np.zeros(0, np.uint32), row["first"]
                done = 0
                while done < len(row["lengths"]):
                    out = []
                    while done < len(row["lengths"]) and len(out) < 2000:
                        n = row["lengths"][done]
                        while len(held) < n:
                            more = next(stream)
                            held = more if not len(held) else np.concatenate([held, more])
                        out.append((row["doc_ids"][done], at, *of(held[:n])))
                        held, at, done = held[n:], at + n, done + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64(), pa.int64(), *(t for _, t in fields)])],
                        names=["doc_id", "start", *(n for n, _ in fields)],
                    )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a file is a row, so rows must not be gathered by their size
    rows = manifest.join(starts, manifest.part == starts._part).repartitionByRange(parts, "part")
    return rows.select("file", "first", "doc_ids", "lengths").mapInArrow(read, "doc_id long, start long, " + schema)
