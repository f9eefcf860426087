"""Physical plans: what must be in them and what must not."""

import pytest
from pyspark.sql import functions as F

from calorix.operators import compare as co
from calorix.operators import metrics as me
from calorix.operators import profile as pr
from calorix.operators import selection as se
from calorix.plans import REGISTRY
from calorix.sources.cutmaps import builtin_cut_map


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_needed_columns(spark, folder):
    text = plan(REGISTRY["pruned_scan"].build(spark, folder))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_filter_reaches_the_scan(spark, folder):
    text = plan(REGISTRY["sql_filter"].build(spark, folder))
    assert "GreaterThanOrEqual(l_extendedprice,15000.0)" in text


def test_partition_filter_prunes_folders(spark, folder):
    assert "PartitionFilters: [isnotnull(event_type" in plan(
        REGISTRY["partitioned_write"].build(spark, folder)
    )


@pytest.mark.parametrize("name", ["best_per_group", "event_top2"])
def test_rank_filter_runs_before_the_shuffle(spark, folder, name):
    lines = plan(REGISTRY[name].build(spark, folder)).splitlines()
    partial = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line]
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert partial and any(i < partial[0] for i in exchanges)


def test_sweep_shuffles_counts_not_samples(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), (F.col("id") / 1000).alias("s"))
    text = plan(me.sweep_counts(df, "y", "s", me.unit_thresholds()))
    assert text.count("Exchange") == 1 and "partial_count_if" in text.lower() or "partial_count" in text


def test_cut_lookup_needs_no_join(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("et"), F.lit(0.5).alias("eta"))
    cell = se.cell_index(builtin_cut_map("loose"), F.col("et"), F.col("eta"))
    text = plan(df.select(cell.alias("cell")))
    assert "Join" not in text and "Exchange" not in text


def test_histogram_is_one_aggregation(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert plan(pr.histogram(df, "x", edges=[0.0, 500.0, 1000.0])).count("HashAggregate") == 2


def test_quantiles_never_gather_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    text = plan(co.exact_quantiles(df, ["g"], "x", {"q": 0.5}))
    assert "percentile" not in text and "collect_list" not in text


@pytest.mark.parametrize(
    "name", ["link_by_hash_last", "link_by_key", "link_cell_to_descriptor", "build_samples"]
)
def test_links_stay_in_the_event_row(spark, folder, name):
    text = plan(REGISTRY[name].build(spark, folder))
    assert "Exchange" not in text and "Join" not in text and text.count("FileScan") == 1
