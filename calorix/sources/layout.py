"""Tables laid out by event, updates of single columns in place, counts taken while writing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from calorix.operators.nested import INFO, LINK_COLUMNS
from calorix.session import checkpoint_root, durable, few


def save_by_event(
    df: DataFrame, table: str, key: str, buckets: int, order: Sequence[str] = ()
) -> DataFrame:
    """Save ``df`` as a table in ``buckets`` buckets of ``key``, each sorted by key and ``order``.

    Tables with the same number of buckets join on the key, and gather per key, without moving a
    row again. The rows are moved once here, a file per bucket. Choose ``buckets`` so that a
    bucket of the largest table is a task's share (some hundred MB); a key stays in one bucket.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{table}-{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
    writer.mode("overwrite").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def update_column(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    id_col: str,
    column: str,
    partition_col: str,
) -> int:
    """Set ``column`` of a partitioned parquet folder in place; returns the touched partitions.

    Rows of an id that ``updates`` (unique by id) names get its value, others keep theirs.
    Partitions in which no value changes are not written: their files keep names and times. The
    touched ones are first written to the checkpoint folder and from there replaced partition by
    partition, so a run that is lost midway leaves whole old or whole new partitions, and running
    it again does the rest; a repeated run finds no change and writes nothing.
    """
    present = spark.read.parquet(path)
    new = updates.where(F.col(id_col).isNotNull()).select(id_col, F.col(column).alias("_new"))
    differs = ~F.col(column).eqNullSafe(F.col("_new").cast(present.schema[column].dataType))
    changes = durable(
        present.select(id_col, column, partition_col).join(new, id_col).where(differs)
        .select(id_col, "_new", partition_col).distinct(),
        "changes",
    )
    touched = few(changes.select(partition_col).distinct(), "touched")
    n = touched.count()
    if n == 0:
        return 0
    # a null partition value is compared as a value
    same = F.col(f"t.{partition_col}").eqNullSafe(F.col(f"w.{partition_col}"))
    rows = present.alias("t").join(touched.alias("w"), same, "left_semi")
    change = changes.select(F.col(id_col).alias("_id"), "_new", F.lit(True).alias("_found"))
    value = F.when(F.col("_found"), F.col("_new").cast(present.schema[column].dataType))
    merged = rows.join(change.dropDuplicates(["_id"]), F.col(id_col) == F.col("_id"), "left").select(
        *[
            value.otherwise(F.col(c)).alias(c) if c == column else F.col(c)
            for c in present.columns
        ]
    )
    staged = durable(merged, "staged")
    # few files per partition; adaptive execution splits a partition that holds most rows
    writer = staged.hint("rebalance", partition_col).write.partitionBy(partition_col)
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return n


def write_counted(
    tables: Mapping[str, DataFrame], root: str, strict: bool = False, mode: str = "error"
) -> DataFrame:
    """Write child tables to ``root/<name>`` and count rows and dangling links in the same job.

    Returns ``table, link, n_rows, n_dangling``, one row per table with a link. The counts come
    with the write itself; a task that is tried again counts once, as nothing is shuffled between
    the links and the files. ``strict`` raises after the writes if a link other than an
    electron's dangles; the written tables are left for a look.
    """
    found = []
    for name, df in tables.items():
        link = LINK_COLUMNS.get(name)
        seen = Observation()
        if link:
            counts = (F.count(F.lit(1)).alias("rows"), F.count_if(F.col(link).isNull()).alias("none"))
            df = df.observe(seen, *counts)
        df.write.mode(mode).parquet(f"{root}/{name}")
        if link:
            found.append((name, link, int(seen.get["rows"]), int(seen.get["none"])))
    broken = [f"{n}: {k} of {r}" for n, _, r, k in found if k and n != "electrons"]
    if strict and broken:
        raise ValueError("dangling links: " + ", ".join(broken))
    spark = next(iter(tables.values())).sparkSession
    schema = "table string, link string, n_rows long, n_dangling long"
    return spark.createDataFrame(found, schema)


def watched_events(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Events with an observation of ``n_events, n_without_one_info``, filled by the first job
    that reads them all; use it where the events are written and nothing shuffles before."""
    seen = Observation()
    wrong = F.coalesce(F.size(INFO), F.lit(-1)) != 1
    counts = (F.count(F.lit(1)).alias("n_events"), F.count_if(wrong).alias("n_without_one_info"))
    return df.observe(seen, *counts), seen
