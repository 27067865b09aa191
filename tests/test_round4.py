"""Findings of round 4."""

import __spark_entry__ as entry


def test_ratio_null_runs_all_thousand_draws(spark):
    got = entry.queries()["v11_ratio_null"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.perm for r in got) == list(range(1000))
    assert "range(0, 1000)" in entry.oracle_sql()["v11_ratio_null"]
