import gzip

import pytest
from pyspark.sql import functions as F

from kinfold.operators import seeds as A
from kinfold.operators.sequence import read_substitution_matrix
from kinfold.plans.studies import compare_runs
from kinfold.sources import documents as D
from kinfold.sources import tables as S
from kinfold.streaming import rowwise


def test_delimited_aliases(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("gene_symbol\tlof.pLI\tnote\nA\t0.5\tx\nB\tNA\t \nC\tbad\ty\nD\tNaN\tz\n")
    df = S.read_delimited(spark, str(p), {"gene": ["gene", "gene_symbol"], "pli": ["pLI", "lof.pLI"]}, numeric=["pli"], required=["gene", "pli"])
    assert [tuple(r) for r in df.orderBy("gene").collect()] == [("A", 0.5), ("B", None), ("C", None), ("D", None)]
    with pytest.raises(ValueError, match="required"):
        S.read_delimited(spark, str(p), {"loeuf": ["oe"]}, required=["loeuf"])


def test_bulk_scores(spark, tmp_path):
    p = tmp_path / "bulk.tsv.gz"
    with gzip.open(p, "wt") as f:
        f.write("# comment\nP1\tA1C\t0.2\t1\nP1\tA1C\t0.9\t2\nP2\tA1C\tnan\t3\nP3\tC2D\t0.4\t4\n")
    bulk = S.read_bulk_scores(spark, str(p), ["acc", "sub", "score", "seen"])
    targets = spark.createDataFrame([("P1", "A1C", 7), ("P1", "A1C", 3), ("P2", "A1C", 4)], "acc string, sub string, t int")
    out = S.wanted_scores(bulk, targets, keys=["acc", "sub"], score="score", order="seen", target_id="t").collect()
    assert [(r.acc, r.t, r.n_collisions, r.score) for r in out] == [("P1", 3, 1, 0.9)]


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">sp|P12345-2|NAME desc\nACDE\nFG\n>plain text\nWW\n")
    assert sorted(tuple(r) for r in D.read_fasta(spark, str(p)).collect()) == [("P12345", "ACDEFG"), ("plain", "WW")]


def test_assay_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mutant,score\nA1C,0.5\nA1C:C2D,1\nZ1C,2\nA9C,3\nA1D,\n")
    index = spark.createDataFrame([("a.csv", "ACD")], "file string, seq string")
    out = S.join_assays(S.read_assays(spark, str(tmp_path)), index, file="file", mutant="mutant", score="score", sequence="seq")
    assert {r.mutant: r.reject for r in out.collect()} == {"A1C": None, "A1C:C2D": "multi_mutant", "Z1C": "letter_mismatch", "A9C": "out_of_bounds", "A1D": "no_score"}


def test_conflicting_reference_raises(spark):
    df = spark.createDataFrame([("d", "wt", "AC", "-"), ("d", "wt", "AD", "-"), ("d", "A1C", "CC", "1")], "domain string, kind string, seq string, t string")
    with pytest.raises(Exception, match="conflicting reference"):
        S.load_stability(df, domain="domain", kind="kind", sequence="seq", target="t").collect()


def test_publish_writes_a_partition_per_seed(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    for seed in (0, 1, 1):
        S.publish(df, str(tmp_path / "out"), run="r", seed=seed, source="s")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4 and {r.seed for r in back.collect()} == {0, 1}


def test_flatten_json_paths_and_depth(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"}],"e":{},"f":[]},"n":null}'), (2, "{bad")], "id int, doc string")
    got = {(r.path, r.value) for r in D.flatten_json(docs, keys=["id"], document="doc").collect()}
    assert got == {("a.b[0]", "1"), ("a.b[1].c", "x"), ("n", None)}
    assert [r.id for r in D.unreadable_json(docs, keys=["id"], document="doc").collect()] == [2]
    with pytest.raises(Exception, match="max_depth"):
        D.flatten_json(docs, keys=["id"], document="doc", max_depth=2).collect()


def test_run_comparison_states(spark):
    shape = "path string, value string, kind string"
    old = spark.createDataFrame([("m.mean", "1.0", "DECIMAL"), ("m.seed_std", "0.5", "DECIMAL"), ("m.state", "available", "STRING"), ("x", "1", "BIGINT"), ("v", "pass", "STRING"), ("gone", "1", "BIGINT"), ("q", "NaN", "DOUBLE")], shape)
    new = spark.createDataFrame([("m.mean", "1.4", "DECIMAL"), ("m.seed_std", "0.5", "DECIMAL"), ("m.state", "available", "STRING"), ("x", "2", "BIGINT"), ("v", "fail", "STRING"), ("new", "1", "BIGINT"), ("q", "1.0", "DOUBLE")], shape)
    got = {r.path: r.state for r in compare_runs(old, new, keys=[]).collect()}
    assert got == {"m.mean": "unchanged", "m.seed_std": "unchanged", "m.state": "unchanged", "x": "moved", "v": "changed", "gone": "removed", "new": "added", "q": "incomparable"}


def test_seed_reducer_on_the_fixture_values(spark):
    full = spark.createDataFrame([(s, (s + 1) / 10) for s in range(5)], "seed int, value double")
    r = A.seed_mean(full, seeds=range(5), value="value").first()
    assert r.state == "available" and r["mean"] == pytest.approx(0.3) and r.spread == pytest.approx(0.15811388300841897)
    short = A.seed_mean(full.where("seed < 2"), seeds=[0, 1], value="value").first()
    assert short["mean"] == pytest.approx(0.15) and short.spread is None
    twice = A.seed_mean(full.unionByName(full.where("seed = 2")), seeds=range(5), value="value").first()
    assert twice.reason == "duplicate_seed" and twice.affected_seeds == [2] and twice.contributing_seeds == []
    odd = A.seed_mean(full.withColumn("value", F.when(F.col("seed") == 4, float("nan")).otherwise(F.col("value"))), seeds=range(6), value="value").first()
    assert odd.reason == "missing_seed" and odd.affected_seeds == [4, 5] and odd["mean"] is None
    with pytest.raises(ValueError):
        A.seed_vote(full, seeds=range(5), value="value", threshold=0.1, minimum=9)


def test_matrix_file(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("# scores\n   A  C\nA  4 -1\nC -1  9\n")
    assert {(r.wt, r.mut): r.score for r in read_substitution_matrix(spark, str(p)).collect()} == {("A", "A"): 4, ("A", "C"): -1, ("C", "A"): -1, ("C", "C"): 9}


def test_rowwise_operators_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p.Arg2Cys", "ARD", 2, "R", "C"), (2, "bad", "ARD", 9, "R", "C")], "id int, change string, s string, p int, a string, b string")
    rows.write.parquet(str(tmp_path / "in"))
    rules = {"out_of_bounds": F.col("p") > F.length("s")}
    options = {"change": "change", "sequence": ("s", "p", "a", "b")}
    stream = rowwise.annotate(rowwise.read_stream(spark, str(tmp_path / "in"), rows.schema), rules, **options)
    q = rowwise.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in rowwise.annotate(rows, rules, **options).orderBy("id").collect()]
    assert got[0].pair.mut_window == "ACD" and got[1].reject == "out_of_bounds"
