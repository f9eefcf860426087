"""Session facts the operators need: durable storage, parallelism, size checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_DRIVER_ROWS = 100_000
_written: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where it is unset, a folder in the session's warehouse, which all executors reach as well, is
    set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def durable(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    Used where two passes must see the very same rows (positions, partition numbers): the
    written table survives executor loss, cuts the lineage, and lets each pass read only its
    columns. ``schema`` reads the table back under a wider schema.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def durable_model(spark: SparkSession, model, label: str):
    """Write a fitted Spark ML model once and read it back: the same parameters, no training summary.

    The summary of a binary model refers to the session, which tasks cannot receive once any query of
    the session has been observed.
    """
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    model.write().save(path)
    _written.append(path)
    return type(model).load(path)


def release_durable(spark: SparkSession) -> int:
    """Delete what :func:`durable` and :func:`durable_model` have written in this process; frames on it are gone."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    n = len(_written)
    _written.clear()
    return n


def collect_bounded(df: DataFrame, limit: int = MAX_DRIVER_ROWS, what: str = "rows") -> list:
    """Collect a frame that must be small; fail instead of pulling an unbounded one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}: too many for the driver")
    return rows


def few(groups: DataFrame, label: str, limit: int = MAX_DRIVER_ROWS) -> DataFrame:
    """A table of one row per group, written, and marked for broadcast if it has few rows.

    A join with it then moves none of the many rows of a group; beyond ``limit`` groups the planner
    chooses, and no group can hold most of the rows' keys unsplit by adaptive execution.
    """
    held = durable(groups, label)
    return F.broadcast(held) if held.count() <= limit else held
