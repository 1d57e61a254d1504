"""Every query that has SQL gives the same rows as DuckDB over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows(records, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = contract.queries()[name](spark, small)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(columns)])
    expected = rows(result.fetchall(), [columns.index(c) for c in sorted(columns)])
    assert got == expected


def test_entry_has_rows(spark, small):
    assert contract.entry(spark).count() > 0


def test_queries_without_sql_run(spark, small):
    for name in ("sim_wer", "win_cluster_rows", "ded_spatial"):
        assert contract.queries()[name](spark, small).count() > 0
