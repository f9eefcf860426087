"""Streams with state of their own: ids that go on across batches, and mergeable exact metrics.

Neither keeps state in memory: what a batch adds is written to a folder of its number, which a replay
replaces, and what came before is read from the folders of smaller numbers. So a batch that is run
again after a failure gives the same files, whatever had been written of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from calorix.operators.metrics import loss_of_counts, max_sp_of_counts, score_counts
from calorix.operators.ordering import with_running_totals

_OFFSETS = "name string, n long, batch_id long"


def _run(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _folders(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the wholly written folders ``prefix=N`` below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    out = []
    for found in files.listStatus(path):
        name = found.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(found.getPath(), "_SUCCESS")
        if name.startswith(f"{prefix}=") and files.exists(done):
            out.append(int(name.split("=")[1]))
    return sorted(out)


def rows_before(spark: SparkSession, out: str, batch_id: int) -> dict[str, int]:
    """How many rows of each table the batches before ``batch_id`` have written."""
    if not any(b < batch_id for b in _folders(spark, f"{out}/_offsets", "batch_id")):
        return {}
    held = spark.read.schema(_OFFSETS).parquet(f"{out}/_offsets").where(F.col("batch_id") < batch_id)
    return {r["name"]: r["n"] for r in held.groupBy("name").agg(F.sum("n").alias("n")).collect()}


def number_batch(
    batch: DataFrame, order: Sequence[str | Column], containers: dict[str, str], first: dict[str, int]
) -> DataFrame:
    """The events of a batch with ``id`` and, for every child table, ``first_<table>``, the id of the
    event's first child: dense numbers in ``order`` that go on from ``first``.

    Events are put in order by ranges and running totals, never in one task; an event's children
    follow each other, so they need no sort of their own.
    """
    sizes = {f"_n_{name}": F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long") for name, c in containers.items()}
    counted = batch.withColumns({"_n": F.lit(1).cast("long"), **sizes})
    totals = {"_n": "_upto", **{f"_n_{name}": f"_upto_{name}" for name in containers}}
    placed = with_running_totals(counted, order, totals)
    starts = [
        (F.col(f"_upto_{name}") - F.col(f"_n_{name}") + first.get(name, 0)).alias(f"first_{name}") for name in containers
    ]
    return placed.select(*batch.columns, (F.col("_upto") - 1 + first.get("events", 0)).alias("id"), *starts)


def stream_numbered(
    events: DataFrame, order: Sequence[str | Column], containers: dict[str, str], out: str, checkpoint: str
) -> StreamingQuery:
    """Convert event batches into an event table and child tables with dense ids over all batches.

    ``containers`` maps a child table to its array column. Tables ``events`` (all columns but the
    containers, with ``id``) and each child (``id``, ``event_id``, ``pos`` and the element's fields)
    are written by batch, as is the number of rows each batch added. A batch starts where the batches
    of smaller numbers end, so a replay gives the same ids; ``order`` should tell events apart.
    """
    names = list(containers)
    if "events" in names:
        raise ValueError("events is the name of the event table")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = rows_before(spark, out, batch_id)
        numbered = number_batch(batch, order, containers, first)
        tables = {"events": numbered.drop(*containers.values(), *[f"first_{n}" for n in names])}
        for name, column in containers.items():
            rows = numbered.select(f"first_{name}", F.col("id").alias("event_id"), F.posexplode(column).alias("pos", "_item"))
            item = "_item.*" if isinstance(events.schema[column].dataType.elementType, T.StructType) else "_item"
            tables[name] = rows.select((F.col(f"first_{name}") + F.col("pos")).alias("id"), "event_id", "pos", item)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        sizes = [F.sum(F.greatest(F.size(c), F.lit(0))).cast("long").alias(n) for n, c in containers.items()]
        added = batch.agg(F.count("*").alias("events"), *sizes)
        listed = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(0)).alias("n")) for n in ("events", *names)])
        counts = added.select(F.inline(listed))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/_offsets/batch_id={batch_id}")

    return _run(events, write, checkpoint)


def stream_scores(
    samples: DataFrame, y: str, score: str, out: str, checkpoint: str, merge_every: int = 20
) -> StreamingQuery:
    """Keep the counts of every distinct score of a stream; a batch writes only what it adds.

    Every ``merge_every`` batches the parts are added up into one table; parts and older tables it
    covers are then deleted. A replayed batch that is covered already is written again and not read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score_counts(batch, y, score).write.mode("overwrite").parquet(f"{out}/part={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            merge_scores(batch.sparkSession, out, batch_id)

    return _run(samples, write, checkpoint)


def _parts(spark: SparkSession, out: str) -> tuple[list[int], list[int]]:
    """The newest merged table, and the parts it does not cover."""
    merged = _folders(spark, out, "upto")[-1:]
    return merged, [p for p in _folders(spark, out, "part") if not merged or p > merged[0]]


def scores_of(spark: SparkSession, out: str) -> DataFrame:
    """The counts of every distinct score of all batches so far."""
    merged, parts = _parts(spark, out)
    paths = [f"{out}/upto={m}" for m in merged] + [f"{out}/part={p}" for p in parts]
    if not paths:
        return spark.createDataFrame([], "threshold double, _pos long, _neg long")
    held = spark.read.parquet(*paths)
    return held.groupBy("threshold").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))


def merge_scores(spark: SparkSession, out: str, upto: int) -> None:
    merged, parts = _parts(spark, out)
    if merged and merged[0] >= upto:
        return
    paths = [f"{out}/upto={m}" for m in merged] + [f"{out}/part={p}" for p in parts if p <= upto]
    total = spark.read.parquet(*paths).groupBy("threshold").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    total.write.mode("overwrite").parquet(f"{out}/upto={upto}")
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:  # covered from now on
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def exact_record(spark: SparkSession, out: str) -> DataFrame:
    """Exact working point, area and cross entropy of all batches so far, as one row."""
    counts = scores_of(spark, out)
    loss = loss_of_counts(counts).first()
    return max_sp_of_counts(counts).withColumns({name: F.lit(loss[name]) for name in loss.asDict()})
