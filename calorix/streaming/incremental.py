"""Incremental forms of the batch operators, as Structured Streaming jobs.

All three are append-only conversions or plain sums, so they need neither watermarks nor custom
state: the state of a sweep is two counts per threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from calorix.operators.metrics import curve_from_counts, sweep_counts
from calorix.operators.nested import child_tables


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as a stream; a folder may keep growing. A batch takes all new files, or at
    most ``files_per_batch`` of them."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_tables(
    events: DataFrame,
    out: str,
    checkpoint: str,
    tables: Callable[[DataFrame], dict[str, DataFrame]] = child_tables,
    key: str = "event_id",
) -> StreamingQuery:
    """Convert event batches into child tables keyed by (event, position).

    Each batch writes its own ``batch_id`` folder and replaces it when it is replayed after a
    failure, so every event is written exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for name, table in tables(batch).items():
            table.write.mode("overwrite").option("compression", "gzip").parquet(
                f"{out}/{name}/batch_id={batch_id}"
            )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sums(
    updates: DataFrame, by: Sequence[str], sums: Sequence[str], out: str, checkpoint: str
) -> StreamingQuery:
    """Running sums per key; the newest complete result replaces the folder ``out``."""
    totals = updates.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    return _complete(totals, out, checkpoint)


def stream_sweep(
    samples: DataFrame,
    y: str,
    score: str,
    thresholds: Sequence[float],
    out: str,
    checkpoint: str,
    inclusive: bool = True,
) -> StreamingQuery:
    """Running sweep counts; :func:`curve_from_sink` turns the sink into a curve."""
    counts = sweep_counts(samples, y, score, thresholds, inclusive)
    return _complete(counts, out, checkpoint)


def _complete(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return (
        result.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def curve_from_sink(spark: SparkSession, out: str, thresholds: Sequence[float]) -> DataFrame:
    return curve_from_counts(spark.read.parquet(out), thresholds)
