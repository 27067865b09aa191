"""The ratio's null from sums inside the tasks equals that of repeated rows."""

import numpy as np
import pandas as pd
import pytest

from kinfold.operators import vectors as V


def test_summed_draws_equal_repeated_rows(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(120, 3))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(120), "family": np.arange(120) % 4, "vec": list(x)}))
    args = dict(row_id="row_id", vec="vec", family="family", n=6, seed=8)
    summed = V.within_between_null(df, **args)
    assert "_shuffled" not in summed._jdf.queryExecution().analyzed().toString()
    got = {r.perm: r for r in summed.collect()}
    monkeypatch.setattr(V, "DRAWN_SUMS", 0)
    for r in V.within_between_null(df, **args).collect():
        assert got[r.perm].ratio == pytest.approx(r.ratio) and got[r.perm].within_pairs == r.within_pairs and got[r.perm].between_pairs == r.between_pairs
    assert len(got) == 6
