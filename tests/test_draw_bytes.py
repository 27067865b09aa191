"""Draws hashed in blocks: the same as md5 one by one, and small in the shuffle."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from kinfold.functions.hashing import digits, equally_long, md5_words
from kinfold.operators import many_draws, shuffles
from kinfold.operators import resample as S


def test_block_hashes_equal_md5():
    for lead in ("", "3|17|all|", "é" * 30, "a" * 57, "b" * 130):
        for lo, hi in equally_long(7, 1203):
            numbers = np.arange(lo, hi)
            words = md5_words([*lead.encode(), *digits(numbers)])
            for i in (0, len(numbers) - 1):
                assert "".join(f"{int(w[i]):08x}" for w in words) == hashlib.md5(f"{lead}{numbers[i]}".encode()).hexdigest()


def test_draws_equal_single_hashes_in_strata_of_any_size(spark):
    rows = [(i, "one" if i == 0 else "few" if i < 8 else "mäny") for i in range(5000)]
    got = {(r.boot, r.gene): r.weight for r in S.cluster_draws(spark.createDataFrame(rows, "gene int, stratum string"), cluster="gene", n_boot=35, seed=4).collect()}
    want: dict = {}
    for label in ("one", "few", "mäny"):
        names = [g for g, s in rows if s == label]
        order = sorted(names, key=lambda c: hashlib.md5(f"unit|{c}".encode()).hexdigest())
        for boot in range(35):
            for i in range(len(names)):
                hit = order[int(hashlib.md5(f"4|{boot}|{label}|{i}".encode()).hexdigest()[:8], 16) % len(names)]
                want[boot, hit] = want.get((boot, hit), 0) + 1
    assert got == want


def test_hits_take_about_a_byte_in_the_shuffle(spark):
    store = spark._jsc.sc().statusStore()
    numbered = S._numbered(spark.range(30000).select(F.col("id").alias("gene")), "gene").withColumnRenamed("_cluster", "gene").localCheckpoint()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    m = many_draws.hit_bytes(numbered, key="_stratum", index="_index", size="_size", cluster="gene", n_draws=64, seed=1)
    assert m.count() == 30000
    assert written() - before < 1.6 * 30000 * 64


def test_subsample_equals_a_plain_order(spark):
    names = [f"g{i}" for i in range(300)] + ["a much longer name", "ü"]
    got = S.cluster_subsamples(spark.createDataFrame([(n,) for n in names], "gene string"), cluster="gene", n_boot=12, seed=6).toPandas()
    for boot, part in got.groupby("boot"):
        order = sorted(names, key=lambda c: hashlib.md5(f"6|{boot}|{c}".encode()).hexdigest())
        assert set(part.gene) == set(order[: round(len(names) * 0.632)]) and (part.weight == 1).all()


def test_subsample_mean_needs_no_table_of_draws(spark):
    df = spark.createDataFrame([(i % 40, float(i)) for i in range(200)], "gene int, x double")
    draws = S.subsample_bytes(df, cluster="gene", n_boot=20, seed=2)
    stat = S.MeanOf("x")
    cells = stat.compress(df, "gene")
    fast = {r.boot: r.value for r in stat.score_draws(cells, draws, "gene", 20).collect()}
    table = many_draws.draw_table(draws, cluster="gene", n_draws=20).withColumnRenamed("weight", "_draws")
    slow = {r.boot: r.value for r in stat.score(cells.join(table, "gene").withColumn("_w", F.col("_w") * F.col("_draws")), ["boot"]).collect()}
    assert fast.keys() == slow.keys() and all(abs(fast[b] - slow[b]) < 1e-9 for b in fast)


def test_remainders_without_division_and_whole_permutations():
    x = np.r_[0, 1, shuffles.PRIME - 1, shuffles.PRIME, shuffles.PRIME + 1, (1 << 62) - 2, np.random.default_rng(0).integers(0, 1 << 62, 1000)].astype(np.int64)
    assert (shuffles._rest(x.copy()) == x % shuffles.PRIME).all()
    y = np.arange(26)
    assert (shuffles._wrapped(y.copy(), 13) == y % 13).all()
    keys = np.random.default_rng(1).integers(0, 1 << 32, (5, shuffles.ROUNDS))
    for m in (1, 2, 7, 100, 1001):
        assert (np.sort(shuffles.landing(np.arange(m), keys, 9, m), axis=0) == np.arange(m)[:, None]).all()


def test_marks_equal_the_lists_of_labels(spark):
    df = spark.createDataFrame([(i, i % 2, "abc"[i % 3]) for i in range(60)], "u int, fold int, label string")
    lists = {r.u: r.labels for r in S.permutation_lists(df, unit="u", label="label", fold="fold", n=9, seed=3).collect()}
    for r in S.permutation_marks(df, unit="u", label="label", fold="fold", classes=("c", "a", "z"), n=9, seed=3).collect():
        of = [[i + 1 for i, v in enumerate(lists[r.u]) if v == c] for c in ("c", "a", "z")]
        assert r["_hits"] == [len(v) for v in of] and r["_marks"] == [sum(v) for v in of]


def test_block_marks_equal_the_long_swaps_and_move_no_row_for_a_draw(spark):
    df = spark.createDataFrame([(c * 10 + k, c, c % 2, "xy"[(c + k) % 2]) for c in range(8) for k in range(3)], "g int, c int, fold int, label string")
    args = dict(group="g", label="label", cluster="c", fold="fold", n=7, seed=5)
    want: dict = {}
    for r in S.permute_cluster_blocks(df, **args).collect():
        n, mark = want.get((r.g, r.label), (0, 0))
        want[r.g, r.label] = n + 1, mark + r.perm + 1
    counted = S.cluster_block_marks(df, **args)
    assert {(r.g, r.label): (r.hits, r.marks) for r in counted.collect()} == want
    assert sum(n for n, _ in want.values()) == 24 * 7
