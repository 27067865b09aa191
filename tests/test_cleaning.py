import pytest
from pyspark.sql import functions as F

from kinfold.functions import notation as N
from kinfold.operators import cleaning as C
from kinfold.operators import groups as G


def test_notation(spark):
    cases = {"p.Arg123Cys": ("R", 123, "C"), "R123C": ("R", 123, "C"), "NP_1:p.Gly7Ala": ("G", 7, "A"), "p.Arg12Ter": None, "p.Arg5Arg": None, "R5*": None, "": None, "p.Xyz5Cys": None, "fs": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.parse_substitution("t").alias("p"))
    for r in df.collect():
        assert (tuple(r.p) if r.p else None) == cases[r.t]


def test_undeclared_label_raises_or_drops(spark):
    df = spark.createDataFrame([("AR",), ("HI",)], "m string")
    with pytest.raises(Exception, match="undeclared label"):
        df.select(N.class_of("m", {"HI": "LOF"})).collect()
    assert [r[0] for r in df.select(N.class_of("m", {"HI": "LOF"}, unexpected="drop")).collect()] == [None, "LOF"]


def test_window_cases(spark):
    seq = "".join(chr(65 + i % 26) for i in range(3000))
    df = spark.createDataFrame([(seq, p) for p in (1, 600, 1500, 2990, 3000)], "s string, p int")
    for r in df.select("p", N.sequence_window("s", "p").alias("w")).collect():
        assert len(r.w.window) <= 1022 and r.w.window[r.w.pos - 1] == seq[r.p - 1] and r.w.window == seq[r.w.start : r.w.start + len(r.w.window)]
    short = spark.createDataFrame([("ACDE", 2)], "s string, p int").select(N.sequence_window("s", "p").alias("w")).first().w
    assert tuple(short) == ("ACDE", 2, 0)
    bad = spark.createDataFrame([("ACDE", 9, "C", "W"), ("ACDE", 2, "A", "W"), ("ACDE", 2, "C", "W"), ("ACDE", 0, "C", "W")], "s string, p int, a string, b string")
    assert [r[0] for r in bad.select(N.apply_substitution("s", "p", "a", "b")).collect()] == [None, None, "AWDE", None]


def test_majority_ties(spark):
    df = spark.createDataFrame([("k", "a", 3), ("k", "b", 1), ("k", "a", 4), ("k", "b", 9)], "k string, v string, o int")
    assert C.majority_value(df, key="k", value="v", ties="first", order="o").first().v == "b"
    assert C.majority_value(df, key="k", value="v", ties="last", order="o").first().v == "b"
    with pytest.raises(Exception, match="tied majority"):
        C.majority_value(df, key="k", value="v").collect()


def test_tier_resolution(spark):
    df = spark.createDataFrame([("one", "x", "strong"), ("top", "x", "definitive"), ("top", "y", "strong"), ("none", "x", "definitive"), ("none", "y", "definitive")], "k string, v string, t string")
    assert dict(C.resolve_by_tier(df, key="k", value="v", tier="t", top="definitive").collect()) == {"one": "x", "top": "x"}


def test_waterfall_names_the_first_failing_rule_and_null_fails(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id int, x int")
    got = {r.id: r.reject for r in C.waterfall(df, {"low": F.col("x") < 1, "big": F.col("x") > 4}).collect()}
    assert got == {1: "big", 2: "low", 3: "low"}


def test_cap_and_balance_with_a_hot_group(spark):
    rows = [(i, "hot" if i < 2000 else f"g{i % 5}", "p" if i % 3 == 0 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, g string, label string")
    n = C.cap_and_balance(df, group="g", label="label", row_id="row_id", cap=50, seed=0).groupBy("g", "label").count().toPandas()
    assert (n["count"] == 50).all() and len(n) == 12
    kept = C.rebalance(df, group="g", label="label", row_id="row_id").groupBy("g").agg(F.count_if(F.col("label") == "p").alias("p"), F.count("*").alias("n")).toPandas()
    assert (kept.n == 2 * kept.p).all() and kept[kept.g == "hot"].p.iloc[0] == 667


def test_strict_balance_raises(spark):
    df = spark.createDataFrame([("g", "p", 1), ("g", "b", 2), ("g", "b", 3)], "g string, label string, k int")
    with pytest.raises(Exception, match="unequal_classes failed"):
        C.balance_report(df, group="g", label="label", keys=["k"], classes=["p", "b"], strict=True).collect()


def test_fingerprint_ignores_partitioning_and_sees_order_and_nulls(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 5 > 0, F.lit("t")).alias("s"))
    one = C.fingerprint(df, ["x", "s"], order="id").first().digest
    assert one == C.fingerprint(df.repartition(9), ["x", "s"], order="id").first().digest
    assert one != C.fingerprint(df.withColumn("id", 499 - F.col("id")), ["x", "s"], order="id").first().digest
    assert C.fingerprint(df, ["s"]).first().digest != C.fingerprint(df.fillna(""), ["s"]).first().digest


def test_residuals_need_two_observed(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 3.0), ("c", "f", None), ("d", "g", 5.0), ("e", None, 2.0), ("h", "k", 1.0), ("i", "k", None)], "gene string, family string, v double")
    r = {x.gene: x for x in G.family_residuals(df, family="family", values=["v"]).collect()}
    assert (r["a"].v_residual, r["b"].v_residual) == (-1.0, 1.0)
    assert all(r[g].v_residual is None for g in "cdehi") and r["d"].family_singleton == 1 and r["h"].family_singleton == 0
    o = {x.gene: x.family_singleton for x in G.family_residuals(df, family="family", values=["v"], singleton_by="observed").collect()}
    assert o == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "h": 1, "i": 1}


def test_self_edges_and_id_like_nodes(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "A")], "a string, b string")
    assert dict(G.undirected_degree(e, a="a", b="b").collect()) == {"A": 2, "B": 1}
    ids = spark.createDataFrame([("1", "2"), ("3", "A")], "a string, b string")
    assert G.symbol_degree(ids, a="a", b="b", id_pattern=r"^\d+$").count() == 0


def test_packed_flags(spark):
    df = spark.createDataFrame([("1|0|x",), ("0|0|0",), ("1",)], "p string").select(*C.unpack_flags("p", ["a", "b", "c"]))
    assert [tuple(r) for r in df.collect()] == [(1, 0, None, 1), (0, 0, 0, 0), (1, None, None, 1)]
