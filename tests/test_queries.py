"""Every registered query of the business part against its SQL in DuckDB, and the rest for rows and schema."""

import os

import duckdb
import numpy as np
import pytest

from quarry import registry
from quarry.session import TABLES


def plain(x):
    if isinstance(x, list | tuple | np.ndarray):
        return str([plain(y) for y in x])
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return "" if x is None else str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in registry.oracles():
        assert len(set(df.columns)) == len(df.columns)
        return
    want = duck.sql(registry.oracles()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert registry.FLAGSHIP in names


def test_top_k_limits_groups_before_the_shuffle(spark, sf):
    plan = registry.queries()["m01_dense_route"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.queries()["b04_in_list"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
