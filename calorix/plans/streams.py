"""Streaming queries: tables written as files, read as a stream, compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calorix.operators import nested
from calorix.operators.metrics import unit_thresholds
from calorix.plans.base import query, rounded, table
from calorix.plans.evaluation import EXACT_POINT_SQL, _curve_columns, _curve_sql, _round_curve, scored_lines
from calorix.plans.events import ITEMS, nested_events
from calorix.session import checkpoint_root
from calorix.streaming import states
from calorix.streaming.incremental import (
    curve_from_sink,
    file_stream,
    stream_sums,
    stream_sweep,
    stream_tables,
)


def _folders(spark, name: str) -> tuple[str, str, str]:
    root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def _as_stream(spark, df, path: str, files_per_batch: int | None = None):
    df.write.parquet(path)
    return file_stream(spark, path, df.schema, files_per_batch)


@query(
    "stream_flatten",
    f"""WITH {ITEMS}
    SELECT event_id, pos, (CASE WHEN ln < n THEN ln END)::DOUBLE AS cluster_pos, q AS e FROM items""",
)
def _stream_flatten(spark, folder):
    source, out, checkpoint = _folders(spark, "flatten")
    events = nested_events(spark, folder, nested.ELECTRONS, nested.CLUSTERS)
    stream = _as_stream(spark, events, source)
    stream_tables(
        stream, out, checkpoint, tables=lambda b: {"electrons": nested.electron_table(b)}
    ).awaitTermination()
    return spark.read.parquet(f"{out}/electrons").select(
        "event_id",
        "pos",
        F.col("cluster_pos").cast("double").alias("cluster_pos"),
        F.col("e").cast("double").alias("e"),
    )


@query("stream_roc", f"WITH {_curve_sql(100, '>=')} SELECT {_curve_columns()} FROM c")
def _stream_roc(spark, folder):
    source, out, checkpoint = _folders(spark, "roc")
    samples = scored_lines(spark, folder).select("y", "score")
    stream = _as_stream(spark, samples, source)
    thresholds = unit_thresholds(100)
    stream_sweep(stream, "y", "score", thresholds, out, checkpoint).awaitTermination()
    return _round_curve(curve_from_sink(spark, out, thresholds))


@query(
    "stream_counters",
    "SELECT event_type, sum(event_id % 10)::BIGINT AS n FROM events GROUP BY event_type",
)
def _stream_counters(spark, folder):
    source, out, checkpoint = _folders(spark, "counters")
    updates = table(spark, folder, "events").select(
        "event_type", (F.col("event_id") % 10).alias("n")
    )
    stream = _as_stream(spark, updates, source)
    stream_sums(stream, ["event_type"], ["n"], out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_ids",
    f"""WITH {ITEMS},
    e AS (SELECT event_id AS key, row_number() OVER (ORDER BY event_id) - 1 AS number
          FROM (SELECT DISTINCT event_id FROM items))
    SELECT row_number() OVER (ORDER BY e.number, pos) - 1 AS id, e.number AS event_id, pos, q AS e
    FROM items JOIN e ON e.key = items.event_id""",
)
def _stream_ids(spark, folder):
    """Electrons of events that arrive in order over several batches, numbered over all of them."""
    source, out, checkpoint = _folders(spark, "ids")
    events = nested_events(spark, folder, nested.ELECTRONS).repartitionByRange(4, "event_id")
    stream = _as_stream(spark, events, source, files_per_batch=4)
    electrons = {"electrons": nested.ELECTRONS}
    states.stream_numbered(stream, ["event_id"], electrons, out, checkpoint).awaitTermination()
    found = spark.read.parquet(f"{out}/electrons")
    return found.select("id", "event_id", "pos", F.col("e").cast("double").alias("e"))


@query("stream_exact_record", EXACT_POINT_SQL)
def _stream_exact_record(spark, folder):
    source, out, checkpoint = _folders(spark, "scores")
    samples = scored_lines(spark, folder).select("y", "score").repartition(6)
    stream = _as_stream(spark, samples, source, files_per_batch=2)
    states.stream_scores(stream, "y", "score", out, checkpoint, merge_every=2).awaitTermination()
    record = states.exact_record(spark, out)
    return rounded(record, 6, *[c for c, t in record.dtypes if t == "double"])
