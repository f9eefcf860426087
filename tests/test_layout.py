"""Layout by event, updates in place, counts taken while writing."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from calorix.functions.sql import register_functions, scaling_params
from calorix.operators import nested
from calorix.plans import layouts
from calorix.plans.events import stored_events
from calorix.sources.layout import save_by_event, update_column, write_counted
from tests.conftest import rows


@pytest.mark.parametrize("build", [layouts.bucketed_samples, layouts.bucketed_nesting])
def test_stored_layout_needs_no_exchange(spark, folder, build):
    plan = build(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Join" in plan or "collect_list" in plan


def test_bucketed_table_keeps_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, 1), (3, 0)], "k int, v int")
    saved = save_by_event(df, f"t_{uuid.uuid4().hex}", "k", 3, ["v"])
    assert rows(saved) == rows(df)
    empty = save_by_event(df.where("v > 5"), f"t_{uuid.uuid4().hex}", "k", 3)
    assert empty.count() == 0


def _files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    given = [(1, "a", 0.0), (2, "a", None), (3, "b", 0.0), (4, None, 0.0), (None, "b", 5.0)]
    spark.createDataFrame(given, "id int, part string, fold double").write.partitionBy(
        "part"
    ).parquet(path)
    return path


def test_update_touches_only_partitions_with_new_values(spark, stored):
    before = _files(stored)
    updates = spark.createDataFrame([(2, 7.0), (3, 0.0), (9, 1.0), (None, 3.0)], "id int, fold double")
    assert update_column(spark, stored, updates, "id", "fold", "part") == 1
    found = rows(spark.read.parquet(stored).select("id", "part", "fold"))
    assert found == [
        (1, "a", 0.0), (2, "a", 7.0), (3, "b", 0.0), (4, None, 0.0), (None, "b", 5.0)
    ]
    after = _files(stored)
    kept = {f: t for f, t in before.items() if "part=a" not in f}
    assert {f: t for f, t in after.items() if "part=a" not in f} == kept
    # a replay changes nothing
    assert update_column(spark, stored, updates, "id", "fold", "part") == 0
    assert _files(stored) == after


def test_update_to_null_and_in_the_null_partition(spark, stored):
    updates = spark.createDataFrame([(4, 2.0), (1, None)], "id int, fold double")
    assert update_column(spark, stored, updates, "id", "fold", "part") == 2
    found = rows(spark.read.parquet(stored).select("id", "fold"))
    assert found == [(1, None), (2, None), (3, 0.0), (4, 2.0), (None, 5.0)]


def test_an_interrupted_update_is_finished_by_a_replay(spark, stored):
    """The state after one of two partitions was replaced."""
    one = spark.createDataFrame([(1, 8.0)], "id int, fold double")
    both = spark.createDataFrame([(1, 8.0), (3, 9.0)], "id int, fold double")
    assert update_column(spark, stored, one, "id", "fold", "part") == 1
    assert update_column(spark, stored, both, "id", "fold", "part") == 1
    found = dict(rows(spark.read.parquet(stored).where("id in (1, 3)").select("id", "fold")))
    assert found == {1: 8.0, 3: 9.0}


def test_counts_of_the_write_equal_those_of_a_job(spark, folder, tmp_path):
    tables = nested.child_tables(stored_events(spark, folder))
    counted = write_counted(tables, str(tmp_path / "children"))
    assert rows(counted) == rows(nested.dangling_links(tables))
    written = spark.read.parquet(str(tmp_path / "children" / "clusters"))
    assert written.count() == tables["clusters"].count()


def test_strict_writes_raise_after_writing(spark, tmp_path):
    kind = "event_id int, pos int, seed_pos int"
    good = spark.createDataFrame([(1, 0, 0)], kind)
    bad = spark.createDataFrame([(1, 0, None), (1, 1, 0)], kind)
    electrons = spark.createDataFrame([(1, 0, None)], "event_id int, pos int, cluster_pos int")
    root = str(tmp_path / "strict")
    with pytest.raises(ValueError, match="truth_particles: 1 of 2"):
        write_counted(
            {"clusters": good, "electrons": electrons, "truth_particles": bad}, root, strict=True
        )
    assert spark.read.parquet(f"{root}/truth_particles").count() == 2


def test_one_statement_serves_any_table(spark):
    register_functions(spark)
    spark.createDataFrame([(1.0, 2, "x"), (3.0, None, "y")], "a double, b int, c string").createOrReplaceTempView("t1")
    spark.createDataFrame([], "k int").createOrReplaceTempView("t2")
    call = "EXECUTE IMMEDIATE scaling_params USING '{}' AS source, '{}' AS pattern"
    assert rows(spark.sql(call.format("t1", "^[ab]$"))) == [("a", 2.0, 1.0), ("b", 2.0, 0.0)]
    assert rows(spark.sql(call.format("t2", "k"))) == []
    wide = scaling_params(spark, "t1", "^[abc]$")
    assert wide.columns == ["avg_a", "avg_b", "std_a", "std_b"]
    assert tuple(wide.first()) == (2.0, 2.0, 1.0, 0.0)
    assert tuple(scaling_params(spark, "t2", "k").first()) == (None, None)
    with pytest.raises(ValueError, match="no numeric column"):
        scaling_params(spark, "t1", "^c$")
