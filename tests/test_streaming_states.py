"""Ids and exact metrics that go on over batches, also when a batch is run again."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from calorix.operators.metrics import exact_max_sp, log_loss
from calorix.streaming import incremental, states

EVENTS = "key long, run int, hits array<struct<e double>>, tags array<string>"


def event(k):
    hits = None if k % 7 == 0 else [(float(k * 10 + j),) for j in range(k % 4)]
    return (k, k // 10, hits, ["t"] * (k % 3))


def expected(keys_by_batch):
    events, hits, tags = [], [], []
    for batch in keys_by_batch:
        for k in sorted(batch):
            key, run, h, t = event(k)
            n = len(events)
            events.append((n, key, run))
            hits += [(len(hits) + j, n, j, e) for j, (e,) in enumerate(h or [])]
            tags += [(len(tags) + j, n, j, x) for j, x in enumerate(t)]
    return events, hits, tags


def written(spark, out):
    tables = [
        spark.read.parquet(f"{out}/{name}").select(*columns)
        for name, columns in (
            ("events", ["id", "key", "run"]),
            ("hits", ["id", "event_id", "pos", "e"]),
            ("tags", ["id", "event_id", "pos", "_item"]),
        )
    ]
    return tuple(sorted(map(tuple, t.collect())) for t in tables)


def convert(spark, source, out, checkpoint):
    schema = spark.createDataFrame([], EVENTS).schema
    stream = incremental.file_stream(spark, source, schema)
    containers = {"hits": "hits", "tags": "tags"}
    states.stream_numbered(stream, ["key"], containers, out, checkpoint).awaitTermination()


def forget_last(checkpoint):
    """Make the stream run its last batch again, as after a failure before the commit."""
    commits = sorted(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    last = commits[-1]
    os.remove(last)
    crc = f"{checkpoint}/commits/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_ids_go_on_over_batches_and_replays(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [list(range(0, 30)), list(range(100, 145)), [50], list(range(200, 260))]
    for n, keys in enumerate(batches, 1):
        random.Random(n).shuffle(keys)
        spark.createDataFrame([event(k) for k in keys], EVENTS).repartition(3).write.mode("append").parquet(source)
        convert(spark, source, out, checkpoint)
        assert written(spark, out) == expected(batches[:n])
        if n in (2, 4):
            forget_last(checkpoint)
            convert(spark, source, out, checkpoint)
            assert written(spark, out) == expected(batches[:n])
    assert states.rows_before(spark, out, 0) == {}
    assert states.rows_before(spark, out, 1)["events"] == 30


def test_an_empty_batch_adds_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    numbered = states.number_batch(spark.createDataFrame([], EVENTS), ["key"], {"hits": "hits"}, {"events": 5})
    assert numbered.count() == 0
    assert states.rows_before(spark, out, 9) == {}
    with pytest.raises(ValueError):
        states.stream_numbered(spark.readStream.format("rate").load(), ["value"], {"events": "x"}, out, out)


@pytest.mark.parametrize("merge_every", [1, 2, 50])
def test_exact_metrics_equal_the_batch_result(spark, tmp_path, merge_every):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df = spark.range(600).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 50 == 7, None).otherwise((F.col("id") * 37 % 101 + F.col("id") % 3 * 20) / 150).alias("s"),
    )
    df.repartition(7).write.parquet(source)
    stream = incremental.file_stream(spark, source, df.schema, files_per_batch=2)
    states.stream_scores(stream, "y", "s", out, checkpoint, merge_every).awaitTermination()

    def check():
        found = states.exact_record(spark, out).first().asDict()
        loss = log_loss(df.where("s IS NOT NULL"), "y", "s").first().asDict()
        assert found == pytest.approx({**exact_max_sp(df, "y", "s").first().asDict(), **loss})

    check()
    forget_last(checkpoint)
    stream = incremental.file_stream(spark, source, df.schema, files_per_batch=2)
    states.stream_scores(stream, "y", "s", out, checkpoint, merge_every).awaitTermination()
    check()


def test_no_batches_have_no_scores(spark, tmp_path):
    assert states.scores_of(spark, str(tmp_path / "none")).count() == 0
