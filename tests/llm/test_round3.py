"""Spelling variants, minimax shards and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import importance, queries, sharding, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
#: Besides the columns that are read, some whose names the operators use themselves.
EXTRA = ["word", "run", "n", "key", "shard", "slot", "size", "score", "rank", "row_key", "w", "name", "a.b", "_bucket"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def given():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(1)
    long = " ".join(f"{rng.getrandbits(40)} Abschnitt{chr(97 + rng.randrange(26))}" for _ in range(20_000))
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t ", long, "one two", "Größere größere GRÖSSERE " * 12, "\0x\0y " * 30, "no-space" * 9000, "éàü" * 70])]
    return rows + [rows[5]] * 3 + [(None, "one two"), (None, None), (7, "Größere " * 25), (8, "w " * 25), (9, "w " * 25)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in odd_rows], f"{DOCS}, {extra}").withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


# --- spelling variants --------------------------------------------------------------------


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def spelled(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    kept = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    return chained(kept)


def chained(kept):
    without = defaultdict(set)
    for w in kept:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :]].add(w)
    form, near = {}, {}
    for w, n in kept.items():
        close = set().union(without.get(w, ()), *(without[w[:i] + w[i + 1 :]] for i in range(len(w))), (w[:i] + w[i + 1 :] for i in range(len(w))))
        near[w] = [v for v in close if v in kept and one_edit(w, v)]
        best = min(near[w], key=lambda v: (-kept[v], v), default=None)
        form[w] = best if best is not None and kept[best] >= 10 * n else None
    out = set()
    for w, n in kept.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), kept.get(form[w])))
    return out


def as_set(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_op11_query_equals_brute_force(spark, given):
    want = spelled(given)
    assert as_set(queries.QUERIES["op11_spelling_variants"](spark, SF)) == want
    assert sum(f is not None for _, f, *_ in want) > 5


def test_op11_odd_rows(odd, odd_rows):
    assert as_set(spelling.variants(odd)) == spelled(odd_rows)
    assert spelling.variants(odd.limit(0)).collect() == []


def test_op11_pairs_of_every_length_and_long_chains(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(7, 10))) for _ in range(300)} | {"é" * k for k in range(7, 12)}
    counts = {w: rng.choice([2, 3, 20, 200, 2000, 20_000]) for w in words}
    for k in range(6):  # a chain of six
        counts["q" * 7 + "".join("z" if i < k else "q" for i in range(6))] = 2 * 10**k
    got = as_set(spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))
    want = chained(counts)
    assert got == want
    assert ("q" * 13, "q" * 7 + "zqqqqq", "q" * 7 + "zzzzzq", 2, 1, 20) in got


# --- minimax shards -----------------------------------------------------------------------


def least(sizes, parts):
    """The smallest capacity by trying every cut (dynamic programme over suffix sums)."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    best = before.copy()
    for _ in range(parts - 1):
        best = np.array([min(max(best[j], before[i] - before[j]) for j in range(i + 1)) for i in range(len(before))])
    return int(best[-1])


@pytest.mark.parametrize("seed", range(6))
def test_op12_capacity_is_the_least_one(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "TOP", 3)  # few segments, so that they are looked at again
    monkeypatch.setattr(sharding, "STEP", 2)
    rng = random.Random(seed)
    texts = ["x" * rng.choice([0, 1, 5, 30, 200]) + str(i) for i in range(rng.choice([3, 40, 90]))]
    rows = [(i, t) for i, t in enumerate(texts * 2 + texts[:1] * rng.choice([1, 60]))]
    docs = spark.createDataFrame(rows, DOCS)
    parts = rng.choice([2, 5, 9])
    cuts = sharding.fit(docs, parts)
    placed = docs.select("doc_id", "text", sharding.text_key().alias("key"), sharding.row_size().alias("size"), sharding.shard_of(cuts).alias("shard")).collect()
    sizes = Counter()
    for r in placed:
        sizes[r.key] += r["size"]
    light = [n for k, n in sorted(sizes.items()) if k not in cuts.heavy]
    rest = parts - len(cuts.heavy)
    assert all(n <= sum(light) / rest for n in light)
    assert cuts.capacity == (least(light, rest) if light else 0)
    loads, homes = Counter(), defaultdict(set)
    for r in placed:
        loads[r.shard] += r["size"]
        homes[r.key].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and set(loads) <= set(range(parts))
    assert all(n <= cuts.capacity for s, n in loads.items() if s >= len(cuts.heavy))
    order = [next(iter(homes[k])) for k in sorted(homes) if k not in cuts.heavy]
    assert order == sorted(order)


def test_op12_query(spark, given):
    rows = queries.QUERIES["op12_minimax_shards"](spark, SF).collect()
    texts = dict(given)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, loads, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        homes[raw].add(r.shard)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_op12_odd_rows(spark, odd, odd_rows):
    rows = sharding.sharded(odd, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(odd.limit(0), 4).collect() == []
    one = spark.createDataFrame([(i, None) for i in range(5)], DOCS)
    assert {(r.shard, r.slot) for r in sharding.sharded(one, 24).collect()} == {(0, i) for i in range(5)}


def test_op12_same_groups_same_shards_whatever_the_partitions(odd):
    a, b = (sorted(map(tuple, sharding.sharded(d, 4).collect()), key=str) for d in (odd, odd.repartition(7)))
    assert a == b


# --- importance resampling ----------------------------------------------------------------


def word_lists(texts):
    return [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER).encode()) for t in texts]


def bucket_lists(texts):
    return [[zlib.crc32(b" ".join(w[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)] for w in word_lists(texts)]


def resampled(rows, target, share):
    raw, wanted = bucket_lists(t for _, t in rows), bucket_lists(target)
    s, t = Counter(b for x in raw for b in x), Counter(b for x in wanted for b in x)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for (doc_id, text), x, w in zip(rows, raw, word_lists(t for _, t in rows), strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= 20])
    order = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(order[: share(len(order))], 1):
        x[4] = k
    return Counter(tuple(x[:5]) for x in out)


def as_counter(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_op13_query_equals_brute_force(spark, given):
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    want = resampled(given, target, lambda n: 5 * n // 100)
    assert as_counter(queries.QUERIES["op13_importance_resampling"](spark, SF)) == want
    assert sum(k[4] is not None for k in want) == max(k[4] or 0 for k in want) > 5


def test_op13_odd_rows(spark, odd, odd_rows):
    target = spark.createDataFrame([("größere w w",), (None,)], "text string")
    got = importance.drawn(importance.scored(odd, target), lambda n: n // 2)
    want = resampled(odd_rows, ["größere w w", None], lambda n: n // 2)
    assert sorted(x[:4] for x in want.elements() if x[4]) == sorted(x[:4] for x in as_counter(got).elements() if x[4])
    assert as_counter(got) == want
    assert importance.resampled(odd.limit(0), target).collect() == []
    assert as_counter(importance.resampled(odd, target.limit(0))) == resampled(odd_rows, [], lambda n: 5 * n // 100)


def test_op13_runs_never_cross_documents():
    texts = pa.array(["a b", "c", None, "", "d" * 700 + " e f g", "\n", "h"])
    document, bucket, words = importance.features(texts)
    got = [sorted(bucket[document == i].tolist()) for i in range(len(texts))]
    assert got == [sorted(b) for b in bucket_lists(texts.to_pylist())]
    assert words.tolist() == [2, 1, 0, 0, 4, 0, 1]


def test_op13_ranks_are_gapless_in_falling_score(spark):
    drawn = [tuple(r) for r in queries.QUERIES["op13_importance_resampling"](spark, "/root/testdata/sf0.01").where("rank is not null").orderBy("rank").select("rank", "score", "doc_id").collect()]
    assert [r[0] for r in drawn] == list(range(1, len(drawn) + 1))
    assert all((-a[1], a[2]) < (-b[1], b[2]) for a, b in pairwise(drawn))


# --- word vectors and FTRL, word by word --------------------------------------------------


def test_op9_word_vectors_and_pooling_equal_sums_word_by_word(spark):
    from kinfold.llm import quality

    texts = ["one two two. three", "", None, "two one", "a-b one\n two ", "één two"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = quality.word_vectors(docs)

    def tokens(t):
        return [m.group().encode() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0D]+", t or "")]

    def bucket(word):
        found, _ = quality._buckets(pa.array([word.decode()]))
        assert len(found) == 1
        return int(found[0])

    index = np.zeros((1 << quality.BITS, quality.SIZE))
    for b in {bucket(w) for t in texts for w in tokens(t)}:
        for k in range(quality.NONZERO):
            index[b, quality.PLACES[b, k]] += quality.SIGNS[b, k]
    sums = np.zeros_like(index)
    for t in texts:
        words = [bucket(w) for w in tokens(t)]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.AROUND), min(len(words), i + quality.AROUND + 1)):
                if j != i:
                    sums[w] += index[words[j]]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    want = sums / np.where(norm > 0, norm, 1)
    assert np.allclose(got, want, atol=1e-6)
    pooled = quality.pooled(pa.array([t or "" for t in texts]), got)
    for t, row in zip(texts, pooled, strict=True):
        words = [bucket(w) for w in tokens(t)]
        mean = np.concatenate([want[words].mean(0), index[words].mean(0)]) if words else np.zeros(quality.POOLED)
        assert np.allclose(row, mean, atol=1e-5)


def test_op10_fit_equals_ftrl_written_out(spark):
    from kinfold.llm import toxicity

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["bad", "good", "word", "Worse", "x"]) for _ in range(rng.randint(0, 12))) for i in range(60)}
    labels = {i: int("bad" in t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    order = [r.doc_id for r in table.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).orderBy("h").collect()]
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for doc in order:
            x = sorted(set(next(iter(toxicity._features(pa.array([texts[doc]])))).tolist()))
            w = {i: weight(i) for i in x}
            b = -bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - labels[doc]
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
            bz, bn = bz + g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / toxicity.ALPHA * b, bn + g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want)
    assert model.bias == pytest.approx(-bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA)) and want
