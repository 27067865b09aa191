"""Personal data: fixed patterns, and a skip-chain conditional random field that keeps a document consistent.

**Base spans.** Email, ip, card and phone by pattern and check, leftmost and non-overlapping for each
kind; a match that fails its check is dropped. They always stay.

**Field.** Nodes are the tokens (runs between white space) that hold a digit or an ``@``; all
other tokens are certain to be no entity, and so are the tokens of an address with a part above 255 and of
a card number that fails Luhn.
Neighbouring nodes share a transition potential. Skip edges join a
token with the one before it that has the same core (punctuation stripped), and with the one before
that has the same digits or the same letters but another core; occurrences form a chain, so edges
grow with the tokens, not with their pairs. Loopy sum-product message passing
gives each node's marginal. A token outside the base spans becomes a span where its
marginal reaches ``SURE`` and a path of skip edges ties it to a base span of that kind, so a
document without base spans gets none.

The weights are fitted by pseudo-likelihood on a bounded sample of documents with
nodes (``MAX_DOCS``, the least by a hash of the id), whose labels are the base spans.

Null texts count as empty; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import packed, sized_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
SURE = 0.9
ROUNDS = 12
#: Documents that the fit uses at most, and nodes that one of them may have.
MAX_DOCS, MAX_NODES = 4000, 400
FEATURES = 1 << 12
STEPS, RATE, DECAY = 150, 0.1, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_EDGE = ".,;:!?\"'*#$%&<>[]{}|"


def _emails(text: str) -> list[tuple[int, int, bool]]:
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), True))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def matches(text: str) -> list[list[tuple[int, int, bool]]]:
    """For each kind all matches of its pattern: start, end, whether the check holds."""
    ips = [(m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))) for m in _IP.finditer(text)]
    cards = [(m.start(), m.end(), 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)) for m in _CARD.finditer(text)]
    phones = [(m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15) for m in _PHONE.finditer(text)]
    return [_emails(text), ips, cards, phones]


class Field(NamedTuple):
    """The nodes of one document: core spans, labels by the base, certain ones, features, edges by type."""

    spans: np.ndarray
    label: np.ndarray
    certain: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    like: np.ndarray


def _hashed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode()) % FEATURES


def _shape(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", s)))[:24]


def field(text: str, found: list[list[tuple[int, int, bool]]]) -> Field:
    spans, features, chain, same, like = [], [], [], [], []
    by_core: dict[str, int] = {}
    by_like: dict[str, int] = {}
    before, last_node, last_token = "", -1, -1
    for t, m in enumerate(_TOKEN.finditer(text)):
        word = m.group()
        if _MARK.search(word) is None:
            before = word
            continue
        core = word.strip(_EDGE) or word
        start = m.start() + word.find(core)
        node, digits = len(spans), _digits(core)
        spans.append((start, start + len(core)))
        context = _shape(before) if _MARK.search(before) else before[:16].lower()
        features.append([_hashed(0), _hashed(1, _shape(core)), _hashed(2, min(len(digits), 20)), _hashed(3, core[:1] if not core[:1].isalnum() else "w", "@" in core), _hashed(4, min(len(core), 30) // 3), _hashed(5, context)])
        if last_token == t - 1 and last_node >= 0:
            chain.append((last_node, node))
        if core in by_core:
            same.append((by_core[core], node))
        key = digits if len(digits) >= 4 else "".join(c for c in core.lower() if c.isalnum())
        if (other := by_like.get(key)) is not None and by_core.get(core) != other:
            like.append((other, node))
        by_core[core] = by_like[key] = node
        before, last_node, last_token = word, node, t
    n = len(spans)
    where = np.array(spans, np.int64).reshape(-1, 2)
    label, certain = np.zeros(n, np.int64), np.zeros(n, bool)
    for kind in range(len(KINDS), 0, -1):  # the first kind listed wins a token of several
        for a, b, good in found[kind - 1]:
            inside = slice(np.searchsorted(where[:, 1], a, "right"), np.searchsorted(where[:, 0], b, "left"))
            if good:
                label[inside] = kind
            elif kind == 2 or kind == 3 and 13 <= len(_digits(text[a:b])) <= 19:
                certain[inside] |= (where[inside, 0] >= a) & (where[inside, 1] <= b)
    certain &= label == 0
    edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return Field(where, label, certain, np.array(features, np.int64).reshape(n, -1), edges(chain), edges(same), edges(like))


class Weights(NamedTuple):
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(fields: list[Field]) -> Weights:
    """Pseudo-likelihood: every node given the labels of its neighbours, by Adam over the whole sample."""
    w = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(2)]
    sizes = np.cumsum([0, *(len(f.label) for f in fields)])
    if not sizes[-1]:
        return Weights(*w)
    y = np.concatenate([f.label for f in fields])
    x = np.concatenate([f.features for f in fields if len(f.label)])
    chain, same, like = (np.concatenate([getattr(f, c) + s for f, s in zip(fields, sizes, strict=False)]).astype(np.int64) for c in ("chain", "same", "like"))
    one = np.eye(LABELS)[y]
    agree = []
    for e in (same, like):
        votes = np.zeros((len(y), LABELS))
        np.add.at(votes, e[:, 0], one[e[:, 1]])
        np.add.at(votes, e[:, 1], one[e[:, 0]])
        agree.append(votes)
    left, right = np.zeros((len(y), LABELS)), np.zeros((len(y), LABELS))
    left[chain[:, 1]], right[chain[:, 0]] = one[chain[:, 0]], one[chain[:, 1]]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, STEPS + 1):
        score = w[0][x].sum(axis=1) + left @ w[1] + right @ w[1].T + w[2][0] * agree[0] + w[2][1] * agree[1]
        g = (_softmax(score) - one) / len(y)
        g0 = np.zeros_like(w[0])
        for k in range(x.shape[1]):
            np.add.at(g0, x[:, k], g)
        grads = [g0 + DECAY * w[0], left.T @ g + g.T @ right + DECAY * w[1], np.array([(g * agree[0]).sum(), (g * agree[1]).sum()]) + DECAY * w[2]]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            w[i] = w[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    w[2] = np.maximum(w[2], 0.0)
    return Weights(*w)


def marginals(f: Field, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over chain and skip edges; labels known from the base are observed."""
    n = len(f.label)
    unary = w.unary[f.features].sum(axis=1)
    unary[f.certain] = np.where(np.arange(LABELS) == 0, 0.0, -1e3)
    known = f.label > 0
    unary[known] = np.where(np.eye(LABELS)[f.label[known]] > 0, 0.0, -1e3)
    edges = np.concatenate([f.chain, f.same, f.like])
    if not len(edges):
        return _softmax(unary)
    tables = np.concatenate([np.repeat(t[None], len(e), 0) for t, e in ((w.chain, f.chain), (w.skip[0] * np.eye(LABELS), f.same), (w.skip[1] * np.eye(LABELS), f.like))])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + tables
        top = out.max(axis=1)
        out = np.log(np.exp(out - top[:, None, :]).sum(axis=1)) + top
        message = 0.5 * message + 0.5 * (out - out.max(axis=1, keepdims=True))  # damped
    belief = unary.copy()
    np.add.at(belief, target, message)
    return _softmax(belief)


def _tied(f: Field) -> np.ndarray:
    """For each node and kind whether skip edges tie the node to a base span of that kind."""
    head = np.arange(len(f.label))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for a, b in np.concatenate([f.same, f.like]).tolist():
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(len(head))], np.int64)
    has = np.zeros((len(head), LABELS), bool)
    has[roots, f.label] = True
    return has[roots]


def added(f: Field, w: Weights) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that the field adds; neighbouring tokens of one kind are one span."""
    if not (f.label > 0).any() or not len(f.same) + len(f.like):
        return []
    p = marginals(f, w)
    best = p[:, 1:].argmax(axis=1) + 1
    rows = np.arange(len(best))
    take = (f.label == 0) & (p[rows, best] >= SURE) & _tied(f)[rows, best]
    follows = {int(b): int(a) for a, b in f.chain}
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(take).tolist():
        prior = follows.get(i, -1)
        start, end = f.spans[i].tolist()
        if prior >= 0 and take[prior] and best[prior] == best[i]:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((int(best[i]) - 1, start, end))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _marked(texts: pa.Array) -> np.ndarray:
    """Which texts hold a digit or an ``@`` at all."""
    data, offsets = packed(texts)
    sums = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    return sums[offsets[1:]] > sums[offsets[:-1]]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Weights:
    """Weights from a bounded sample of documents that have nodes."""
    chosen = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)).alias("_order"))
    chosen = chosen.orderBy("_order", "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_docs ids

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            found = [(at, field(t, matches(t))) for at, t in zip(batch.column("_order").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            found = [(at, f) for at, f in found if 0 < len(f.label) <= MAX_NODES]
            yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in found], pa.int64()), *(pa.array([x[1][i].astype(np.int64).tobytes() for x in found], pa.binary()) for i in range(len(Field._fields)))], names=["at", *Field._fields])

    found = rows.select("_order", "text").mapInArrow(gather, "at long, " + ", ".join(f"{c} binary" for c in Field._fields)).collect()
    fields = []
    for row in sorted(found, key=lambda r: (r["at"], bytes(r["spans"]))):
        get = lambda c, row=row: np.frombuffer(row[c], np.int64)
        label = get("label")
        fields.append(Field(get("spans").reshape(-1, 2), label, get("certain").astype(bool), get("features").reshape(len(label), -1), *(get(c).reshape(-1, 2) for c in ("chain", "same", "like"))))
    return train(fields)


def find_personal(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are those of the base."""
    counts = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long"
    empty = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            texts, rows = batch.column("text"), []
            for i, marked in enumerate(_marked(texts).tolist()):
                if not marked:
                    rows.append((0, 0, 0, 0, empty, "", 0))
                    continue
                text = texts[i].as_py()
                found = matches(text)
                base = [(k, a, b) for k, spans in enumerate(found) for a, b, good in spans if good]
                more = added(field(text, found), weights) if base else []
                n = np.bincount([k for k, _, _ in base], minlength=len(KINDS)).tolist()
                rows.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + more), len(more)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names=["doc_id", *counts, "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)
