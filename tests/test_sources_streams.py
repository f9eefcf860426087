"""Readers, writers, legacy inputs, names, SQL functions and streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calorix import session
from calorix.functions import names as na
from calorix.functions import physics as ph
from calorix.functions import vectors as ve
from calorix.functions.sql import register_functions
from calorix.operators.metrics import roc_curve, unit_thresholds
from calorix.schemas import EVENT_SCHEMA, N_RINGS, NTUPLE_SCHEMA, RING_LAYERS
from calorix.sources import legacy, readers, writers
from calorix.streaming import incremental as st
from tests.conftest import rows


def test_schemas():
    assert len(EVENT_SCHEMA) == 8 and len(NTUPLE_SCHEMA) == 53
    assert sum(size for _, _, size in RING_LAYERS) == N_RINGS
    clusters = EVENT_SCHEMA["CaloClusterContainer_Clusters"].dataType.elementType
    assert clusters["cell_links"].dataType == T.ArrayType(T.LongType())


def test_reading_mixed_paths(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a" / "deep"))
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "b"))
    part = next((tmp_path / "b").glob("*.parquet"))
    both = readers.read_inputs(spark, [str(tmp_path / "a"), str(part)])
    assert both.count() == 5
    assert readers.read_inputs(spark, [str(part)], dev=True).count() == 2
    assert readers.files_read(both).agg(F.sum("n_rows")).first()[0] == 5
    with pytest.raises(ValueError, match="not a .parquet file"):
        readers.read_inputs(spark, [str(tmp_path / "file.root")])


def test_corrupt_file_is_skipped(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "bad.parquet").write_bytes(b"not a parquet file")
    schema = spark.range(1).schema
    assert readers.read_inputs(spark, str(tmp_path / "in"), schema, skip_corrupt=True).count() == 4
    with pytest.raises(Exception, match="bad.parquet"):
        readers.read_inputs(spark, str(tmp_path / "in"), schema).count()
    short = readers.read_inputs(spark, str(tmp_path / "in"), schema, skip_corrupt=True)
    skipped = readers.skipped_files(spark, str(tmp_path / "in"), short).collect()
    assert [(r.file.rpartition("/")[2], r.n_bytes) for r in skipped] == [("bad.parquet", 18)]


def test_event_scan_fills_missing_fields(spark, tmp_path):
    df = spark.createDataFrame([([(1.0, 2),],)], "SeedContainer_Seeds array<struct<e:float,id:int>>")
    df.write.parquet(str(tmp_path / "ev"))
    row = readers.event_scan(spark, str(tmp_path / "ev")).first()
    assert row["SeedContainer_Seeds"][0]["id"] == 2 and row["SeedContainer_Seeds"][0]["phi"] is None


def test_query_frame(spark):
    spark.range(5).withColumn("label", F.col("id") % 2).createOrReplaceTempView("numbers")
    x, y = readers.query_frame(spark, "SELECT id, label FROM numbers;", ["label"], limit=3)
    assert x.columns == ["id"] and y.columns == ["label"] and x.count() == 3
    with pytest.raises(ValueError):
        readers.query_frame(spark, "SELECT 1")
    with pytest.raises(ValueError):
        readers.query_frame(spark, "DROP TABLE numbers;")


def test_append_modes(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2, "y")], "other int, names string")
    assert rows(writers.append_by_position(a, b)) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        writers.append_by_position(a, a.select("n"))
    c = spark.createDataFrame([("z",)], "s string")
    assert rows(writers.append_by_name(a, c)) == [(1, "x"), (None, "z")]


def test_labelled_sources(spark):
    registry = writers.source_registry(spark, [("sig", None, 1), ("bkg", "background", 0)])
    df = spark.createDataFrame([("bkg",), ("other",)], "src string")
    assert rows(writers.labelled_sources(df, "src", registry)) == [
        ("bkg", 2, 0),
        ("other", None, None),
    ]


def test_conf_lists_must_agree(spark):
    df = spark.createDataFrame([("a", "1; 2", "x; y")], "k string, v string, n string")
    out = legacy.conf_to_rows(df, {"v": "double", "n": "string"}, keep=["k"])
    assert rows(out) == [("a", 0, 1.0, "x"), ("a", 1, 2.0, "y")]
    bad = spark.createDataFrame([("1; 2", "x")], "v string, n string")
    with pytest.raises(PySparkException, match="list sizes differ"):
        legacy.conf_to_rows(bad, {"v": "double", "n": "string"}).collect()


def test_glued_blocks_get_ids_only_when_missing(spark):
    a = spark.createDataFrame([(0, 5), (1, 6)], "row int, x int")
    b = spark.createDataFrame([(1, "q"), (0, "p")], "row int, y string")
    assert rows(legacy.glue_blocks([a, b], ["row"], "id", start=7)) == [
        (0, 5, "p", 7),
        (1, 6, "q", 8),
    ]
    assert "id" not in legacy.glue_blocks([a, b], ["row"]).columns


def test_dotted_names(spark):
    flat = spark.createDataFrame([(1, 2, 3)], "`a.b.c` int, `a.b.d` int, `a.e` int")
    packed = na.unflatten_columns(flat)
    assert packed.first().asDict(recursive=True) == {"a": {"b": {"c": 1, "d": 2}, "e": 3}}
    assert na.flatten_columns(packed).columns == flat.columns
    listed = spark.createDataFrame([([10, 20],)], "v array<int>")
    assert na.flatten_columns(listed, {"v": 2}).first().asDict() == {"v.0": 10, "v.1": 20}
    assert na.prefix_columns(listed, "train.", keep=()).columns == ["train.v"]


def test_name_rewrites(spark):
    df = spark.createDataFrame([("run-1.root.12",), ("x.root",)], "n string")
    out = df.select(na.run_number_before_extension("n"), na.identifier("n"))
    assert rows(out) == [("run-1.12.root", "run_1_root_12"), ("x.root", "x_root")]


def test_params(spark):
    df = spark.createDataFrame([("None",), ('{"k": 1}',), ("plain",), (None,)], "p string")
    out = df.select(na.decode_param("p").alias("d")).select("d.text", "d.is_json", "d.json")
    assert [tuple(r) for r in out.collect()] == [
        (None, False, None),
        ('{"k": 1}', True, {"k": "1"}),
        ("plain", False, None),
        (None, False, None),
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -3.0],), ([1.0, -1.0],), ([],)], "v array<float>")
    out = df.select(ve.l1_normalise("v"), ve.all_within("v", 2.0), *ve.open_vector("v", 3))
    assert [tuple(r) for r in out.collect()] == [
        ([0.5, -1.5], False, 1.0, -3.0, None),
        ([1.0, -1.0], True, 1.0, -1.0, None),
        ([], True, None, None, None),
    ]
    assert ve.open_vector("v", 1, "{name}[{i}]", start=1)[0]._jc.toString().endswith("v[1]")


def test_angles(spark):
    df = spark.createDataFrame([(0.0, 3.0, 0.0, -3.0)], "a double, b double, c double, d double")
    out = df.select(ph.delta_r("a", "b", "c", "d"), ph.trigger_delta_phi("b", "d")).first()
    assert tuple(out) == pytest.approx((2 * 3.141592653589793 - 6, 2 * 3.141592653589793 - 6))
    with pytest.raises(ValueError):
        ph.between("a", 0, 1, "most")


def test_box_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 0.25)], "eta double, phi double, de double, dp double")
    eta, phi = ph.eta_phi_range("eta", "phi", "de", "dp")
    assert tuple(df.select(eta, phi).first()) == ((0.5, 1.5), (1.75, 2.25))
    edge = df.select(ph.in_box(F.lit(1.5), F.lit(2.0), "eta", "phi", "de", "dp")).first()[0]
    assert edge is False


def test_sql_functions(spark):
    register_functions(spark)
    out = spark.sql(
        "SELECT standard_scaler(3, 1, 2), standard_scaler(3, 1, 0),"
        " ringer_l1(array(1F, -3F)), ringer_norm(array(1F, -1F)), sp_index(1, 0)"
    ).first()
    assert tuple(out) == (1.0, None, 2.0, 1.0, 1.0)


def test_durable_tables_go_to_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    files = session.durable(spark.range(3), "unit").inputFiles()
    assert files and all(root in f for f in files)
    assert session.release_durable(spark) > 0 and session.release_durable(spark) == 0
    with pytest.raises(ValueError):
        session.collect_bounded(spark.range(10), 5)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(400).select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 11 / 10).alias("s")
    )
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    thresholds = unit_thresholds(21)
    stream = st.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=2)
    st.stream_sweep(
        stream, "y", "s", thresholds, str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    found = st.curve_from_sink(spark, str(tmp_path / "out"), thresholds)
    assert rows(found) == rows(roc_curve(df, "y", "s", thresholds))


def test_stream_continues_with_new_files(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k string, n long"
    for batch in ([("a", 1), ("b", 2)], [("a", 10)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = st.file_stream(spark, source, T.StructType.fromDDL(schema))
        st.stream_sums(stream, ["k"], ["n"], out, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(out)) == [("a", 11), ("b", 2)]
