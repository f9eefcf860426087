"""Queries over tables laid out by event, in-place updates and counts taken while writing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calorix.operators import nested
from calorix.operators.samples import sample_rows
from calorix.plans.base import REGISTRY, query, table
from calorix.plans.events import ITEMS, LINE_FIELDS, stored_events
from calorix.session import checkpoint_root
from calorix.sources.layout import save_by_event, update_column, watched_events, write_counted

BUCKETS = 8


@query("bucketed_samples", REGISTRY["build_samples"].sql)
def bucketed_samples(spark, folder):
    """Clusters joined to their event where both are stored in buckets of the event id."""
    containers = (nested.CLUSTERS, nested.SEEDS, nested.RINGS, nested.INFO)
    stored = stored_events(spark, folder, *containers)
    tag = uuid.uuid4().hex
    clusters = save_by_event(
        nested.cluster_table(stored), f"clusters_{tag}", "event_id", BUCKETS, ["pos"]
    )
    events = nested.event_table(stored).withColumnRenamed("id", "event_id")
    events = save_by_event(events, f"events_{tag}", "event_id", BUCKETS)
    # no broadcast hint: the layout makes the join local whatever the sizes
    samples = sample_rows(clusters, events.withColumnRenamed("event_id", "id").hint("merge"), 1, 0)
    parity = F.col("event_id") % 2
    return samples.select(
        (F.when(parity == 0, 1).otherwise(2)).cast("long").alias("source_id"),
        "event_id",
        "cluster_id",
        F.col("eventNumber").cast("double").alias("event_number"),
        F.col("avgmu").cast("double").alias("avgmu"),
        F.round(F.col("cl_et").cast("double"), 2).alias("cl_et"),
        F.round(F.col("cl_eta").cast("double"), 6).alias("cl_eta"),
        parity.cast("byte").alias("label"),
    )


@query(
    "bucketed_nesting",
    f"""WITH {ITEMS}
    SELECT event_id AS l_orderkey, CAST(count(*) AS INTEGER) AS n_items,
           sum(pk * (pos + 1))::BIGINT AS weighted_parts
    FROM items GROUP BY event_id""",
)
def bucketed_nesting(spark, folder):
    """Lines gathered per event from buckets of the event id."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_FIELDS)
    name = f"lines_{uuid.uuid4().hex}"
    stored = save_by_event(lines, name, "l_orderkey", BUCKETS, ["l_linenumber"])
    items = F.sort_array(F.collect_list(F.struct(*LINE_FIELDS)))
    nested_rows = stored.groupBy("l_orderkey").agg(items.alias("items"))
    weighted = F.transform("items", lambda x, i: x["l_partkey"] * (i + 1))
    return nested_rows.select(
        "l_orderkey",
        F.size("items").alias("n_items"),
        F.aggregate(weighted, F.lit(0).cast("long"), lambda s, x: s + x).alias("weighted_parts"),
    )


@query(
    "fold_update",
    """SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 5)::DOUBLE ELSE -1.0::DOUBLE END AS fold
       FROM orders""",
)
def fold_update(spark, folder):
    """A fold written into stored orders; only the partition with new values is replaced."""
    path = f"{checkpoint_root(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders.withColumn("fold", F.lit(-1.0)).write.partitionBy("o_orderstatus").parquet(path)
    fold = F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 5).cast("double"))
    updates = orders.select("o_orderkey", F.coalesce(fold, F.lit(-1.0)).alias("fold"))
    update_column(spark, path, updates, "o_orderkey", "fold", "o_orderstatus")
    return spark.read.parquet(path)


@query("written_links", REGISTRY["dangling_links"].sql)
def written_links(spark, folder):
    """All child tables written, with rows and dangling links counted by the writes."""
    root = f"{checkpoint_root(spark)}/children-{uuid.uuid4().hex}"
    return write_counted(nested.child_tables(stored_events(spark, folder)), root)


@query("watched_events", REGISTRY["event_info_check"].sql)
def written_events(spark, folder):
    """The check of the events' info entries taken while they are written."""
    path = f"{checkpoint_root(spark)}/watched-{uuid.uuid4().hex}"
    events, seen = watched_events(stored_events(spark, folder, nested.INFO))
    events.write.parquet(path)
    counts = [(int(seen.get["n_events"]), int(seen.get["n_without_one_info"]))]
    return spark.createDataFrame(counts, "n_events long, n_without_one_info long")
