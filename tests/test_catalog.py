"""Every SQL-checked query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.catalog.registry import ORACLES

SF = "/root/testdata/sf0.001"
CHECKED = sorted(n for n in entry.oracle_sql() if n in ORACLES)  # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return f"f:{v + 0.0:.4f}"
    return f"{type(v).__name__}:{v}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == table(columns, result.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
