"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import bpe, exact_dedup, mixing, near_dedup, nearest, personal, quality, suffix_dedup, token_files, toxicity
from kinfold.llm.common import row_key

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")
#: Besides the columns of documents some whose names the operators use themselves.
EXTRA = ["id", "key", "score", "ids", "recipe", "anchor", "size", "copies", "_y", "row", "component", "row_key"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def odd_rows():
    rng = random.Random(0)
    long = " ".join(str(rng.getrandbits(40)) for _ in range(30_000))
    texts = [None, "", " \n\t ", long, long + " end", "one", "one", "a@b.cd 10.0.0.1", "no-space" * 20_000, None]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src0", None) for i, t in enumerate(texts)]
    rows += [rows[5]] * 3 + [(None, "one", None, None, None), (None, None, None, None, None), (7, "a@b.cd 10.0.0.1", None, None, None)]
    return [(*r, *["x"] * len(EXTRA)) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, None, None), (5, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda d, _: suffix_dedup.remove_repeats(d),
    "op2": lambda d, _: exact_dedup.duplicate_groups(d),
    "op4": lambda d, _: token_files.token_digests(token_files.write_token_files(d, PLAIN, 2)),
    "op5": lambda d, _: personal.find_personal(d, personal.fit(d)),
    "op6": lambda d, _: near_dedup.near_duplicates(d),
    "op7": lambda d, _: bpe.round_trip(d, MULTI),
    "op8": lambda d, _: mixing.taken(d),
    "op9": lambda d, y: d.select("doc_id", quality.score(quality.fit(d, y)).alias("p")),
    "op10": lambda d, y: d.select("doc_id", toxicity.score(toxicity.fit(d, y)).alias("p")),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_its_row(odd, labels, name):
    rows = RUNS[name](odd, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in odd_rows())


@pytest.mark.parametrize("name", RUNS)
def test_an_empty_table_gives_an_empty_result(odd, labels, name):
    assert RUNS[name](odd.limit(0), labels.limit(0)).collect() == []


def test_defined_results(odd, labels):
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (5, 1, 5, True), (6, 1, 5, False), (None, 1, None, True), (4, 29997, 3, False)} <= near
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(odd).collect()}
    assert {(5, 5, 6, True), (6, 5, 6, False), (None, 5, 6, False), (0, 2, 5, False), (2, 2, 5, True)} <= exact
    tokens = {r.doc_id: r.n_tokens for r in token_files.token_digests(token_files.write_token_files(odd, PLAIN, 2)).collect() if r.doc_id is not None}
    assert tokens[0] == tokens[1] == 1
    scores = {r.p for r in RUNS["op10"](odd.where("text is null or text = ''"), labels).collect()}
    assert len(scores) == 1
    none = odd.select(toxicity.score(toxicity.fit(odd, labels.limit(0))).alias("p"), quality.score(quality.fit(odd, labels.limit(0))).alias("q")).collect()
    assert {r.p for r in none} == {0.0} and {r.q for r in none} == {0.5}


def test_op3_edges(spark):
    schema = "vec_id long, embedding array<float>, d int, asked string"
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (0, [1.0, 0.0], 1, "x"), (5, [1.0, 0.0], 1, "x"), (7, [1.0, 0.0], 1, "x"), (9, [1.0], 1, "x"), (100, None, 1, "x"), (None, [2.0, 2.0], 1, "x"), (200, [], 1, "x")], schema)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(few, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(set(got)) == [(0, 1, 5, 0.0), (0, 2, 7, 0.0)]
    assert nearest.nearest(few.limit(0), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, labels, stage, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    for docs in (odd, odd.limit(0)):
        out = run(spark, docs, str(tmp_path))
        n = out.count()
        assert (n == 0) == (docs is not odd)
        if stage != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_maps_and_dotted_names_beside_the_columns_of_documents(spark):
    rows = [(1, "one two", "s", {"k": 1, "l": 2}, "x", [{"a": None}]), (1, "one two", "s", {"l": 2, "k": 1}, "x", [{"a": None}]), (2, "one two", "s", None, "x", None), (3, None, None, {}, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, `a.b` string, parts array<map<string,int>>")
    for key in (row_key, mixing.row_key):
        keys = [r[0] for r in docs.select(key(docs)).collect()]
        assert keys[0] == keys[1] and len(set(keys)) == 3
    assert {(r.doc_id, r.kept) for r in exact_dedup.duplicate_groups(docs).collect()} >= {(2, False), (3, True)}
    assert near_dedup.near_duplicates(docs).count() == 4
    assert sum(r.taken for r in mixing.taken(docs).collect()) > 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() > 0
    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "near_dedup"):
        assert stages[name](spark, docs, "").columns == docs.columns
