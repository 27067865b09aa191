import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import splits as P


@pytest.fixture(scope="module")
def genes(spark):
    """20 groups × 10 rows in 5 families, one group unannotated."""
    rows = [(g * 10 + i, f"g{g}", None if g == 19 else f"f{g % 5}", ["a", "b", "c"][(g + i) % 3]) for g in range(20) for i in range(10)]
    return spark.createDataFrame(rows, "row_id long, gene string, family string, label string")


def test_group_folds_are_disjoint_and_complete(genes):
    f = P.assign_group_folds(genes, group="gene", n_folds=5, seed=0).toPandas()
    assert len(f) == 200 and (f.groupby("gene")["fold"].nunique() == 1).all()
    assert (f.groupby("fold")["gene"].nunique() == 4).all()
    again = P.assign_group_folds(genes.repartition(7), group="gene", n_folds=5, seed=0).toPandas()
    assert f.set_index("row_id")["fold"].equals(again.set_index("row_id")["fold"].loc[f.row_id])
    other = P.assign_group_folds(genes, group="gene", n_folds=5, seed=1).toPandas()
    assert not f.set_index("row_id")["fold"].sort_index().equals(other.set_index("row_id")["fold"].sort_index())


def test_family_folds_leave_unannotated_rows_out(genes):
    f = P.assign_group_folds(genes, group="family", n_folds=5, seed=0).toPandas()
    assert "g19" not in set(f.gene) and (f.groupby("family")["fold"].nunique() == 1).all()


def test_round_robin_rejects_or_holds_rows_without_a_group(genes):
    with pytest.raises(Exception, match="no group"):
        P.round_robin_folds(genes, group="family", n_folds=3, seed=0).collect()
    held = P.round_robin_folds(genes, group="family", n_folds=3, seed=0, null_group="hold").toPandas()
    assert set(held[held.gene == "g19"].fold) == {-1}


def test_solo_groups_are_spread(genes):
    f = P.family_folds_with_solo(genes, gene="gene", family="family", n_folds=3, seed=0).toPandas()
    assert len(f) == 200 and f.fold.between(0, 2).all()


def test_contract_reports_each_defect(genes):
    folds = P.assign_group_folds(genes, group="gene", n_folds=4, seed=0).select("row_id", "fold")
    sides = P.fold_sides(folds, row_id="row_id", n_folds=4)
    check = lambda s, group="gene", n=4: {r.failure for r in P.contract_failures(s, genes, row_id="row_id", label="label", n_folds=n, classes=("a", "b", "c"), group=group).collect()}
    assert check(sides) == set()
    assert "group_crossing" in check(sides, group="family") or check(sides, group="family") == set()
    assert check(sides.where("NOT (side = 'test' AND row_id = 3)")) == {"coverage"}
    assert check(sides, n=5) == {"fold_count"}
    extra = sides.where("side = 'test' AND row_id = 3").withColumn("side", F.lit("train"))
    assert {"overlap", "group_crossing"} <= check(sides.unionByName(extra))
    assert "missing_class" in {r.failure for r in P.contract_failures(sides, genes, row_id="row_id", label="label", n_folds=4, classes=("a", "zz")).collect()}


def test_row_tested_twice_raises(spark):
    s = spark.createDataFrame([(1, 0, "test"), (1, 1, "test")], "row_id int, fold int, side string")
    with pytest.raises(Exception, match="more than one fold"):
        P.fold_index(s, row_id="row_id").collect()


def test_matched_rows_balance_every_family(spark):
    rows = [(i, f"f{i % 6}", (i % 7) < 3 if i % 6 else True, f"k{i % 4}" if (i % 7) < 3 or i % 6 == 0 else f"c{i % 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, family string, pos boolean, slot string")
    m = P.family_matched_rows(df, row_id="row_id", family="family", positive="pos", slot="slot", seed=0).toPandas()
    counts = m.groupby(["family", "pos"]).size().unstack()
    assert "f0" not in set(m.family) and (counts[True] == counts[False]).all()
    top = P.family_matched_rows(df, row_id="row_id", family="family", positive="pos", slot="slot", seed=0, target_ratio=1.2).toPandas()
    assert (top.pos.sum()) == round(1.2 * (~top.pos).sum()) and set(top[top.pick == "topped_up"].family) == {"f0"}
    size = P.size_matched_rows(df, spark.createDataFrame(m), row_id="row_id", positive="pos", slot="slot", seed=1).toPandas()
    assert (size.pos.value_counts() == m.pos.value_counts()).all()


def test_turns_cycle_over_slots(spark):
    df = spark.createDataFrame([(i, "u", "a" if i < 2 else "b") for i in range(7)], "row_id long, unit string, slot string")
    t = P._turn(df, unit=["unit"], slot="slot", row_id="row_id", seed=0).orderBy("_turn").toPandas()
    assert list(t["_turn"]) == list(range(7)) and list(t["slot"]) == ["a", "b", "a", "b", "b", "b", "b"]


def test_triplets_cross_families_and_classes(genes):
    t = P.cross_family_triplets(genes, row_id="row_id", label="label", family="family", per_anchor=6).toPandas()
    info = genes.toPandas().set_index("row_id")
    a, p, n = (info.loc[t[c]].reset_index(drop=True) for c in ("anchor", "positive", "negative"))
    assert (a.label == p.label).all() and (a.label != n.label).all()
    assert p.family.notna().all() and (a.family != p.family).all()
    assert (t.groupby("anchor").size() == 6).all() and len(set(t.anchor)) == 200


def test_halves_and_stratified_folds(genes):
    h = P.half_partitions(genes, group="gene", n_partitions=3, seed=0).toPandas()
    assert (h.groupby(["partition", "half"]).size() == 10).all()
    s = P.stratified_folds(genes.where("family IS NOT NULL"), row_id="row_id", stratum="family", n_folds=4, seed=0).toPandas()
    per = s.groupby(["family", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1) <= 1).all()
    assert isinstance(per, pd.DataFrame)


def test_nested_positions_equal_two_ranks_and_need_one_shuffle_of_rows(spark, monkeypatch):
    from kinfold.functions import ranking

    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("label"), F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("family"))
    got = {r.row_id: (r._outer, r._inner) for r in ranking.nested_hash_rank(rows, "label", "family", ["row_id"], "row").collect()}
    outer = {r.row_id: r.rank for r in ranking.hash_rank(rows.where("label IS NOT NULL"), ["label"], ["row_id"], "row").collect()}
    inner = {r.row_id: r.rank for r in ranking.hash_rank(rows.where("label IS NOT NULL AND family IS NOT NULL"), ["label", "family"], ["row_id"], "row").collect()}
    assert got == {i: (r, inner.get(i)) for i, r in outer.items()}
    widest = []
    plain = ranking.nested_hash_rank
    monkeypatch.setattr(P, "nested_hash_rank", lambda *a: widest.append(a) or plain(*a))
    P.cross_family_triplets(rows, row_id="row_id", label="label", family="family", per_anchor=4)
    assert len(widest) == 1  # one numbering serves the positive and the negative pool
