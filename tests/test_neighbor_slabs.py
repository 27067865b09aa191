"""The neighbour join where little can be pruned: a query travels once to each slab, not to each shell."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinfold.operators import neighbors as K


def written(spark):
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def frame(spark, x, **cols):
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "vec": [v.tolist() for v in x], **cols}))


def test_knn_sends_a_query_once_to_each_slab(spark):
    x = np.random.default_rng(4).normal(size=(3000, 32))
    x[1500:1520] = x[0]
    df, stats = frame(spark, x), {}
    before = written(spark)
    got = K.knn_join(df, df, k=5, block_rows=64, n_pivots=60, stats=stats).toPandas().sort_values(["query", "rank"])
    assert written(spark) - before < 3000 * 50 < stats["pairs"] / 20
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    assert (got["neighbor"].to_numpy().reshape(-1, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 5), np.sort(d, axis=1)[:, :5], atol=2e-9)


def test_purity_null_reads_a_graph_that_is_built_once(spark):
    from kinfold.catalog.registry import QUERIES

    plan = QUERIES["v10_purity_null"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan


def test_purity_null_compares_bytes_of_classes(spark):
    from kinfold.operators.shuffles import shuffled_codes, shuffled_labels

    for classes in (3, 400):
        rows = spark.range(800).select(F.col("id").alias("row_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), F.col("id") % classes)).alias("label"))
        graph = spark.range(1600).select((F.col("id") % 800).alias("query"), (F.col("id") * 37 % 800).alias("neighbor"))
        got = K.purity_null(graph, rows, row_id="row_id", label="label", k=2, n=30, seed=5).toPandas().set_index("perm")["purity"].sort_index()
        drawn = {r.row_id: r._shuffled for r in shuffled_labels(rows, row_id="row_id", label="label", n=30, seed=5).collect()}
        want = [sum(drawn[r.query][b] is not None and drawn[r.query][b] == drawn[r.neighbor][b] for r in graph.collect()) / 1600 for b in range(30)]
        assert np.allclose(got, want)
        assert {len(r._codes) for r in shuffled_codes(rows, row_id="row_id", label="label", n=30, seed=5).collect()} == {30 if classes == 3 else 120}


def test_knn_reads_its_queries_once_in_each_pass(spark):
    x = np.random.default_rng(6).normal(size=(2000, 16))
    df, read = frame(spark, x), spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    got = K.knn_join(df.coalesce(1).mapInPandas(counted, df.schema), df, k=4, block_rows=64, n_pivots=40).toPandas().sort_values(["query", "rank"])
    assert read.value == 2 * len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    assert (got["neighbor"].to_numpy().reshape(-1, 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()


def test_slabs_of_wide_vectors_hold_fewer_rows():
    meta = pd.DataFrame({"block": range(100), "cell": np.arange(100) // 25, "n": 4096, "low": 0.0, "high": 1.0, "first_id": range(100)})
    for width, blocks in ((64, 16), (4096, 1)):
        assert K._Shells(np.eye(4, width), meta).slab.max() + 1 == -(-100 // blocks)


def test_true_finds_what_nonzero_finds():
    rng = np.random.default_rng(7)
    for shape in ((512, 512), (3, 5), (8, 7), (1, 1)):
        mask = rng.random(shape) < 0.1
        assert all((a == b).all() for a, b in zip(K._true(mask), np.nonzero(mask), strict=True))
