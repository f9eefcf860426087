"""Positions, ranks and running totals on data where one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from calorix.operators.ordering import (
    with_group_rank,
    with_position,
    with_running_totals,
    with_scan_index,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows: a third share one key, and a third of those are identical copies."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1)
    value = F.when(F.col("id") % 9 == 0, 7).otherwise(F.col("id") % 200)
    return spark.range(3000).select(key.alias("k"), value.alias("v")).repartition(6)


def test_positions_are_dense_and_ordered(skewed):
    found = [tuple(r) for r in with_position(skewed, ["k", "v"], "p").orderBy("p").collect()]
    assert [r[2] for r in found] == list(range(3000))
    assert [r[:2] for r in found] == sorted(r[:2] for r in found)


def test_position_start(skewed):
    assert with_position(skewed, ["k"], "p", start=10).agg(F.min("p"), F.max("p")).first() == (
        10,
        3009,
    )


@pytest.mark.parametrize("hot_rows", [1_000_000, 500, 1])
def test_group_rank_matches_sorting(skewed, hot_rows):
    ranked = with_group_rank(skewed, ["k"], ["v"], "r", "n", hot_rows).collect()
    by_key = {}
    for k, v in sorted((r["k"], r["v"]) for r in skewed.collect()):
        by_key.setdefault(k, []).append(v)
    found = {}
    for r in sorted(ranked, key=lambda r: (r["k"], r["r"])):
        found.setdefault(r["k"], []).append(r["v"])
        assert r["n"] == len(by_key[r["k"]])
    assert found == by_key


@pytest.mark.parametrize("hot_rows", [1_000_000, 1, 0])
def test_group_rank_keeps_null_groups(spark, hot_rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    ranked = with_group_rank(df, ["g"], ["v"], "r", hot_rows=hot_rows)
    assert rows(ranked) == [("a", 5, 1), (None, 1, 1), (None, 2, 2)]


def test_small_groups_are_ranked_by_one_exchange(skewed):
    plan = with_group_rank(skewed, ["k"], ["v"], "r")._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 1
    assert "rangepartitioning" not in plan.toString()


def test_running_totals(spark):
    df = spark.range(1, 1001).select(F.col("id"), (F.col("id") * 2).alias("x")).repartition(5)
    for r in with_running_totals(df, ["id"], {"x": "t"}).collect():
        assert r["t"] == r["id"] * (r["id"] + 1)


def test_scan_index_follows_the_input(spark):
    df = spark.range(1000).repartition(3).coalesce(2)
    expected = [r[0] for r in df.collect()]
    found = with_scan_index(df, "n").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, 1001))
    assert [r["id"] for r in found] == expected


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert with_position(df, ["k"], "p").count() == 0
    assert with_group_rank(df, ["k"], ["v"], "r").count() == 0
