"""Every stage of the pipeline against brute force on what it was given."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken
from test_operators import linked, water_level, words

import __spark_entry__ as entry
import corpus_pipeline
from kinfold.llm import bpe
from kinfold.llm.common import row_key

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_each_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        given[name] = (before, docs)
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, out = given["toxicity"]
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    kept = {r[0] for r in rows_of(out)}
    assert set(rows_of(out)) <= set(before)
    clean = [i for i, _, _ in before if toxic.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(i in kept for i, y in toxic.items() if y == 1) <= 0.3 * sum(toxic.values())

    before, out = given["exact_dedup"]
    groups = {}
    for i, text, _ in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i))
    assert sorted(i for i, _, _ in rows_of(out)) == sorted(min(g)[1] for g in groups.values())

    before, out = given["near_dedup"]
    stays = {i for i, v in linked({i: text or "" for i, text, _ in before}).items() if v[2]}
    assert sorted(i for i, _, _ in rows_of(out)) == sorted(stays)

    before, out = given["mixing"]
    size = {i: len((text or "").split()) for i, text, _ in before}
    source = {i: s for i, _, s in before}
    times = Counter(i for i, _, _ in rows_of(out))
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    totals = [sum(size[i] for i in size if source[i] == n) for n in names]
    assert set(times) <= set(size) and max(times.values()) <= 3
    for n, target in zip(names, water_level(totals), strict=True):
        own = [i for i in size if source[i] == n]
        assert abs(sum(times[i] * size[i] for i in own) - target) <= max(size[i] for i in own)

    before, out = given["byte_bpe"]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for i, text, _ in before:
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want


def test_the_entry_lists_all_eleven():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def _shared_and_null_ids():
    """Rows (doc_id, text) with large null keys, ids that stand for several texts, and whole rows that repeat."""
    rng = random.Random(21)
    base, other = words(rng, 60).split(), words(rng, 60)
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (3, 20, 40)]
    rows = [(3, "A"), (7, "A"), (7, "B"), (None, "A"), (None, "A"), (None, "only null"), (None, "only null"), (None, "on ly null"), (8, None), (None, "")]
    rows += [(None, near[0])] * 20 + [(11, near[1]), (11, other), (12, other + " z"), (5, other), (13, near[2]), (2, "B"), (2, words(rng, 30))]
    return rows


def test_exact_stage_keeps_one_row_of_each_group_under_null_and_shared_ids(spark):
    rows = _shared_and_null_ids()
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, (i, text)))
    want = {k: {g[3] for g in v if g[:3] == min(v, key=lambda g: g[:3])[:3]} for k, v in groups.items()}  # the rows that tie for best
    out = [tuple(r) for r in corpus_pipeline.drop_exact(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    got = {re.sub(r"[\x20\x09-\x0D]", "", text or ""): (i, text) for i, text in out}
    assert len(out) == len(groups) and all(got[k] in want[k] for k in want)


def test_near_stage_links_every_text_under_null_and_shared_ids(spark):
    rows = sorted(set(_shared_and_null_ids()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    groups = {}
    for place, (_, head, _) in linked({k: text or "" for k, (_, text) in enumerate(rows)}).items():
        groups.setdefault(head, []).append(rows[place])
    out = [tuple(r) for r in corpus_pipeline.drop_near(spark, spark.createDataFrame(_shared_and_null_ids(), "doc_id long, text string"), SF).collect()]
    assert len(out) == len(groups)
    for members in groups.values():
        kept = [r for r in members if r in out]
        first = min((i is None, i or 0) for i, _ in members)
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == first


def test_row_keys_tell_where_a_null_stands(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, "x", None)], "doc_id long, text string, source string")
    assert rows.select(row_key(rows).alias("k")).distinct().count() == 2
