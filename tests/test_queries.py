"""Every registered query against its SQL on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(folder):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return str(value) if value is not None else None


def normal(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in found)


def check_plan(df):
    """No query pairs all rows with all rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    check_plan(df)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == normal(columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    check_plan(df)
    assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert "total_tp_et_cl_et_ratio" in df.columns
