"""The training-data operators against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import bpe, components, exact_dedup, mixing, near_dedup, nearest, personal, queries, suffix_dedup, token_files

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, size=4):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n))


@pytest.fixture(scope="module")
def given():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


# --- suffix-array dedup -------------------------------------------------------------------


def removed(texts: dict, length: int) -> dict:
    raw = {k: t.encode() for k, t in texts.items()}
    seen = Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_op1_query_equals_brute_force(spark, given):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op1_suffix_array_dedup"](spark, SF).collect()}
    assert got == removed(given, 200)


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_op1_crowded_anchors_give_the_same_marks(spark, crowd):
    rng = random.Random(5)
    passage = words(rng, 60)
    texts = {i: words(rng, rng.randint(0, 60)) + passage * rng.randint(0, 2) + words(rng, 20) for i in range(25)}
    texts |= {100: "é" * 300, 101: "é" * 300, 102: "x" * 1000, 103: "", 104: None, 105: "a b" * 40}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, crowd=crowd).collect()}
    assert got == removed({k: t or "" for k, t in texts.items()}, 200)


def test_op1_suffix_order_is_the_sorted_order():
    rng = random.Random(3)
    for _ in range(200):
        contexts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(1, 6))]
        times = np.array([rng.choice([1, 1, 2]) for _ in contexts], float)
        seen = Counter()
        for c, t in zip(contexts, times, strict=True):
            for i in range(len(c) - 7):
                seen[c[i : i + 8]] += t
        for c, marks in zip(contexts, suffix_dedup.repeated_starts(contexts, times, 8), strict=True):
            assert [seen[c[i : i + 8]] >= 2 for i in range(len(c) - 7)] == marks.tolist()


def test_op1_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "q" + "ab" * 200), (2, "z" + "ab" * 200 + "!")], DOCS)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert kept == {1: b"q", 2: b"z!"}


# --- exact dedup --------------------------------------------------------------------------


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_op2_recipes_tell_texts_apart_even_with_weak_digests(spark, digest_bytes):
    rng = random.Random(1)
    texts = {}
    for i in range(0, 400, 4):
        t = words(rng, rng.choice([3, 50, 3000]))
        texts |= {i: t, i + 1: t.replace(" ", " \n"), i + 2: t + "x", i + 3: words(rng, 2)}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs, digest_bytes).collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(texts[i]), i))
        for i in members:
            assert got[i] == (keep, len(members), i == keep)


def test_op2_chunks_join_to_the_text_and_survive_a_shift():
    rng = random.Random(2)
    data = words(rng, 40_000).encode()
    whole = exact_dedup.chunks_of(data)
    assert b"".join(whole) == data and max(map(len, whole)) <= exact_dedup.MOST_CHUNK
    assert len(set(whole) & set(exact_dedup.chunks_of(b"shifted " + data))) > len(whole) // 2


# --- nearest neighbours -------------------------------------------------------------------


def test_op3_factor_one_is_exact_and_the_default_reaches_its_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8))
    vectors = (centres[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 8))).astype(np.float32)
    vectors[200:260] = vectors[200]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] + [1.0] * 7), (9300, [None] + [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = vectors.astype(float)
    want = {}
    for q in range(0, 1500, 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        want[q] = [int(i) for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
    for factor, least in ((1.0, 1.0), (nearest.FACTOR, 0.9)):
        got = {}
        for r in nearest.nearest(table, F.col("vec_id") % 100 == 0, factor=factor, shard_rows=400).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == set(want)
        assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= least
        if factor == 1.0:
            assert got == want


def test_op3_pruning_visits_fewer_rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 6))
    v = centres[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 6))
    tree = nearest.build(np.arange(4000), v)
    exact, _, all_rows = nearest.search(tree, np.arange(0, 4000, 40), v[::40], 10, 1.0)
    near, _, fewer = nearest.search(tree, np.arange(0, 4000, 40), v[::40], 10, nearest.FACTOR)
    assert fewer < all_rows < 100 * 4000 / 3
    assert (near <= exact + 1e-12).mean() >= 0.9


def test_op3_recall_of_the_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    got = queries.QUERIES["op3_nearest_neighbours"](spark, SF).collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        near = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len({r.vec_id for r in got if r.query_id == q} & set(near))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


# --- token files --------------------------------------------------------------------------


def test_op4_query_equals_the_library(spark, given):
    library = Tokenizer.from_file(PLAIN)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op4_token_files"](spark, SF).collect()}
    at = 0
    for i in sorted(given):
        ids = [*library.encode(given[i], add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op4_slices_runs_and_files_of_bounded_size(spark, given):
    library = Tokenizer.from_file(PLAIN)
    rng = random.Random(6)
    texts = {i: "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\n ", "\u00a0 ", "\x1c ", "\x0b ", "'s", "7", "é", ".", "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for i in range(300)}
    own = token_files.Tokenizer(PLAIN)
    for part in (pa.array(list(texts.values())), pa.array(list(given.values())), pa.array([], pa.string()), pa.array([""])):
        ids, lengths = own.encode(part, 2)
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in part.to_pylist()]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    docs = spark.createDataFrame([*texts.items(), *[(7, t) for t in list(texts.values())[:20]]], DOCS).repartition(1)
    manifest = token_files.write_token_files(docs, PLAIN, 2, sequence=16, batch=2, file_ids=500)
    assert manifest.where("n_ids > 0").count() >= 4
    got = sorted((r.doc_id, bytes(r.ids)) for r in token_files.read_token_files(manifest).collect())
    assert got == sorted((i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in [*texts.items(), *[(7, t) for t in list(texts.values())[:20]]])
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.token_digests(manifest).collect())
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:], strict=False))


def test_op4_added_tokens_in_a_text_are_those_of_the_plain_call(spark):
    library = Tokenizer.from_file(PLAIN)
    texts = {0: "one <|endoftext|> two", 1: "x<|endoftext|>y  <|endoftext|>", 2: "<|endoftext|>", 3: "plain"}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(token_files.write_token_files(docs, PLAIN, 2)).collect()}
    at = 0
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert i == 3 or 50256 in ids
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op4_sequences_are_views_of_the_file_in_order(spark):
    rng = random.Random(7)
    texts = {i: words(rng, rng.randint(0, 400)) for i in range(60)}
    manifest = token_files.write_token_files(spark.createDataFrame(list(texts.items()), DOCS), PLAIN, 2, sequence=64, batch=4)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in token_files.read_token_files(manifest).collect()}
    flat = []
    for row in manifest.orderBy("part").collect():
        file = token_files.TokenFile(row.file)
        ids = []
        for k in range(sum(b.num_rows for b in file.batches)):
            values, mask = file.sequence(k)
            assert len(values) == 64 and not values.flags.owndata
            ids += values[np.array(mask)].tolist()
        assert len(ids) == row.n_ids
        flat += ids
    assert flat == [x for i in sorted(texts) for x in back[i].tolist()]


# --- personal data ------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            good = [True, k == 1 and max(map(int, m.group().split("."))) <= 255, 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0, 9 <= len(d) <= 15][k]
            if good:
                out.append((k, *m.span()))
    return out


def test_op5_matches_follow_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice("a0179.@-+ ()%") for _ in range(rng.randint(0, 40)))
        got = [(k, a, b) for k, found in enumerate(personal.matches(text)) for a, b, good in found if good]
        assert sorted(got) == sorted(base_spans(text))


def test_op5_query_keeps_every_base_span(spark, given):
    for r in queries.QUERIES["op5_personal_data"](spark, SF).collect():
        base = base_spans(given[r.doc_id])
        written = [f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",") if r.spans else [])


def test_op5_the_field_ties_a_repeated_part_to_its_entity(spark):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 8)} +1 (559) 555-{rng.randint(1000, 9999)} {words(rng, 5)} x.{i}@mail{i}.example.com {words(rng, 4)} {rng.randint(1, 99)} pages") for i in range(300)]
    rows += [(1000, "call +1 (559) 555-3817 now or later dial 555-3817 please"), (1001, "room 12 page 555-3817"), (1002, "999.1.2.3 and 999.1.2.3 or 4929123456789012")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.spans for r in personal.find_personal(docs, personal.fit(docs.where("doc_id < 1000"))).where("doc_id >= 1000").collect()}
    assert got == {1000: "phone:5:22,phone:41:49", 1001: "", 1002: ""}


# --- near dedup ---------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(texts: dict) -> dict:
    sets, where, head = {i: shingles(t) for i, t in texts.items()}, {}, {i: i for i in texts}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in where[g] if j > i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def test_op6_query_equals_brute_force(spark, given):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.QUERIES["op6_minhash_near_dedup"](spark, SF).collect()}
    assert got == linked(given)


def test_op6_large_groups_and_common_passages(spark):
    rng = random.Random(8)
    base, passage = words(rng, 120).split(), words(rng, 90)
    texts = {}
    for i in range(150):  # near copies of one text, a few of them far from the first
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        texts[i] = " ".join(copy)
    for i in range(200, 350):  # a passage that all share
        texts[i] = words(rng, rng.randint(8, 40)) + " " + passage + " " + words(rng, rng.randint(2, 20))
    texts |= {400: "One  two", 401: "one two", 402: "one two three four five", 403: " ", 404: ""}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS)).collect()}
    assert got == linked(texts)


@pytest.mark.parametrize("blocks", [1, 8])
def test_op6_groups_alone_find_all(spark, blocks):
    rng = random.Random(9)
    passage = words(rng, 100)
    texts = {i: words(rng, rng.randint(3, 30)) + " " + passage for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    ids = docs.select(F.col("doc_id").alias("id"))
    groups = ids.select(F.lit(0).cast("long").alias("head"), "id", F.col("id").alias("component"), F.lit(blocks).alias("blocks"))
    heads = {r.id: r.component for r in components.components(near_dedup.group_links(groups, near_dedup.full_sets(docs, ids))).collect()}
    assert {i: heads.get(i, i) for i in texts} == {i: v[1] for i, v in linked(texts).items()}


def test_op6_dropped_pairs_have_a_negligible_posterior():
    for i, floor in enumerate(near_dedup.least_matches()):
        n = (i + 1) * near_dedup.BATCH
        s = np.linspace(0, 1, 200_001)
        with np.errstate(divide="ignore"):
            density = np.exp((floor - 1) * np.log(s) + (n - floor + 1) * np.log1p(-s)) if floor else None
        if floor:
            assert density[s >= 0.75].sum() / density.sum() < 1.01 * near_dedup.MISS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (200, 202)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}


# --- byte-level BPE -----------------------------------------------------------------------


def test_op7_equals_the_library_on_odd_texts():
    rng = random.Random(1)
    own = bpe.codec(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    odd = ["".join(rng.choice(" \n\t\r\x1c\x1f\x85\xa0 　aé1٣,'s漢😀​́") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    odd += ["x" * 5000, "ab" * 3000, " " * 1000, "   a", "a   ", " a", "a ", "", "don't we'll", "<|endoftext|>"]
    odd += [f"a {chr(c)} b{chr(c)}c  {chr(c)} " for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_op7_perfect_hash_is_minimal():
    own = bpe.codec(MULTI)
    assert sorted(own.table.slot_key.tolist()) == list(range(len(own.tokens)))
    assert own.table.candidates(own.tokens).tolist() == list(range(len(own.tokens)))


def test_op7_query_and_columns(spark, given):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    for r in queries.QUERIES["op7_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(given[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(given[r.doc_id].encode()).hexdigest())
    docs = spark.createDataFrame([(1, "a naïve text"), (2, None)], DOCS)
    rows = bpe.decode(bpe.encode(docs, MULTI), MULTI).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.bytes)) for r in rows} == {1: (library.encode_ordinary("a naïve text"), "a naïve text".encode()), 2: ([], b"")}


# --- mixing -------------------------------------------------------------------------------


def water_level(sizes: list[int]) -> list[float]:
    """Targets by the rule itself: share, cut at three times the size, share the excess again."""
    weights, total = [1 + i % 3 for i in range(len(sizes))], float(sum(sizes))
    full: set[int] = set()
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        more = {i for i in open_ if share[i] > 3 * sizes[i]}
        if not more:
            return [3.0 * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= more


def test_op8_words_come_near_the_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([0, 3, 30, 200]), 2), rng.choice(["b", "b", "b", "b", "a", "c", None, "é", "zz"]), i % 7) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    got = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = mixing.taken(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again} and len(got) == len(rows)
    size = {i: len(t.split()) for i, t, _, _ in rows}
    names = ["a", "b", "c", "zz", "é", None]
    totals = [sum(size[i] for i, _, s, _ in rows if s == n) for n in names]
    for name, whole, target in zip(names, totals, water_level(totals), strict=True):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {whole} and all(abs(r.target - target) < 1e-6 for r in own)
        assert all(r.size == size[r.doc_id] and r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 200


def test_op8_pivot_keeps_the_sum_and_the_expectations():
    rng = random.Random(0)
    hits = np.zeros(6)
    sizes, shares = [7.0, 3.0, 9.0, 2.0, 5.0, 1.0], [0.3, 0.8, 0.5, 0.1, 0.6, 0.9]
    for _ in range(4000):
        out = mixing.pivot([rng.getrandbits(62) for _ in sizes], sizes, shares)
        assert sum(0 < p < 1 for p in out) <= 1
        assert abs(np.dot(out, sizes) - np.dot(shares, sizes)) < 1e-9
        hits += out
    assert np.abs(hits / 4000 - shares).max() < 0.04


def test_op8_mixed_rows_follow_the_plan(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 20), rng.choice("abc"), 1) for i in range(200)] + [(5000, "same row", "a", 1)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.copies
    rowsout = mixing.mixed(docs)
    assert rowsout.columns == docs.columns
    assert Counter(r.doc_id for r in rowsout.collect()) == +plan


# --- classifiers --------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "parts", "rest", "cut"), [("op9_quality", "quality", 3, 1, 0.5), ("op10_toxicity", "toxic", 4, 2, 0.3)])
def test_classifiers_on_held_out_rows(spark, name, label, parts, rest, cut):
    sf = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.95
    if label == "toxic":
        assert np.mean([p for _, y, p in held if y]) > 0.7 and np.mean([p for _, y, p in held if not y]) < 0.02
    else:
        assert np.mean([p == y for _, y, p in held]) > 0.95


# --- SQL ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_units_join_to_the_text():
    from kinfold.llm.pieces import units

    for text in ("", " ", "a b", "a  b", " a", "a ", "a\n b", "x\x1c y"):
        first, rest = units(text)
        assert first + "".join(" " + u for u in rest) == text


def test_packed_slices_and_nulls():
    from kinfold.llm.common import packed, sized

    texts = pa.array(["ab", None, "é", "", "xyz" * 10])
    assert packed(texts.slice(1, 3))[1].tolist() == [0, 0, 2, 2]
    assert [len(p) for p in sized(texts, 4)] == [4, 1]
