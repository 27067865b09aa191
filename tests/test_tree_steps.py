"""Trees look up their next node, and their blocks lie in several tasks whatever a join left."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.operators import routed_trees as T


def test_looked_up_nodes_equal_compared_ones():
    rng = np.random.default_rng(0)
    tree = T._seed(3)
    tree.feature[:7] = [0, 1, -1, 2, 0, -1, -1]
    tree.bin[:7] = [10, 200, 0, 0, 254, 0, 0]
    tree.null_left[:7] = [True, False, False, True, False, False, False]
    x = rng.integers(0, 256, (500, 3)).astype(np.uint8)
    x[::7, 0] = x[::5, 1] = T.NULL
    for depth in (0, 1, 2, 3):
        want = []
        for row in x:
            at = 0
            for _ in range(depth):
                j = tree.feature[at]
                if j >= 0:
                    left = tree.null_left[at] if row[j] == T.NULL else row[j] <= tree.bin[at]
                    at = 2 * at + (1 if left else 2)
            want.append(at)
        assert tree.nodes(x, True, depth).tolist() == want


def test_blocks_lie_in_several_tasks(spark):
    rows = spark.range(6000).coalesce(1).select(F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    blocks = T._packed(rows, vec="x", target=F.col("y"), fold="fold", folds=[0, 1, 2], edges=[[np.array([9.0])]] * 3, first=[np.zeros(1)] * 3, n_rows=6000)
    held = [r["n"] for r in blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert len(held) == 6 and sum(held) == 6000
