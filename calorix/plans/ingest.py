"""Sources, sinks, projections and names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calorix.functions.names import (
    code_to_name,
    decode_param,
    flatten_columns,
    identifier,
    run_number_before_extension,
    unflatten_columns,
)
from calorix.functions.sql import register_functions, scaling_params
from calorix.functions.vectors import open_vector
from calorix.operators.compare import run_records
from calorix.operators.samples import cast_features, tag_and_filter
from calorix.plans.base import eta, eta_sql, query, rounded, table
from calorix.schemas import SAMPLING_NAMES
from calorix.session import checkpoint_root, collect_bounded
from calorix.sources.legacy import conf_to_rows, explode_references, glue_blocks
from calorix.sources.readers import (
    files_read,
    ntuple_scan,
    query_frame,
    read_frame,
    read_inputs,
)
from calorix.sources.writers import (
    append_by_name,
    append_by_position,
    labelled_sources,
    numbered_sources,
    table_from_files,
    write_frame,
    write_gzip,
)


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("parquet_roundtrip", "SELECT event_id, user_id, event_type, value, props FROM events")
def _parquet_roundtrip(spark, folder):
    path = _scratch(spark, "roundtrip")
    events = table(spark, folder, "events").drop("ts")
    write_gzip(events, path)
    return spark.read.schema(events.schema).parquet(path)


@query(
    "partitioned_write",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
       WHERE event_type = 'click' GROUP BY event_type""",
)
def _partitioned_write(spark, folder):
    path = _scratch(spark, "by-type")
    write_gzip(table(spark, folder, "events"), path, partition_by=["event_type"])
    kept = spark.read.parquet(path).where(F.col("event_type") == "click")
    return kept.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("input_set", "SELECT 1::BIGINT AS n_files, (SELECT count(*) FROM orders) AS n_rows")
def _input_set(spark, folder):
    rows = read_inputs(spark, [folder], pattern="orders.parquet", skip_corrupt=True)
    return files_read(rows).agg(
        F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows")
    )


@query(
    "ntuple_scan",
    """SELECT CAST(vec_id AS INTEGER) AS event_number, NULL::DOUBLE AS cl_et,
         embedding[1]::DOUBLE AS "cl_rings.0", embedding[2]::DOUBLE AS "cl_rings.1",
         embedding[64]::DOUBLE AS "cl_rings.63", embedding[65]::DOUBLE AS "cl_rings.64"
       FROM embeddings""",
)
def _ntuple_scan(spark, folder):
    path = _scratch(spark, "ntuple")
    write_gzip(
        table(spark, folder, "embeddings").select(
            F.col("vec_id").cast("int").alias("EventNumber"), F.col("embedding").alias("cl_rings")
        ),
        path,
    )
    opened = ntuple_scan(spark, path, open_vectors={"cl_rings": 65})
    return opened.select(
        F.col("EventNumber").alias("event_number"),
        F.col("cl_et").cast("double").alias("cl_et"),
        *[F.col(f"`cl_rings.{i}`").cast("double").alias(f"cl_rings.{i}") for i in (0, 1, 63, 64)],
    )


@query("pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def _pruned_scan(spark, folder):
    return read_frame(spark, folder, "lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("saved_frame", "SELECT p_partkey, p_size FROM part")
def _saved_frame(spark, folder):
    root = _scratch(spark, "frames")
    write_frame(table(spark, folder, "part"), root, "parts")
    return read_frame(spark, root, "parts", ["p_partkey", "p_size"])


@query(
    "append_tables",
    """SELECT event_id, user_id, value FROM events WHERE event_id % 2 = 0
       UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 2 = 1""",
)
def _append_tables(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    odd = events.where("event_id % 2 = 1").toDF("a", "b", "c")
    return append_by_position(events.where("event_id % 2 = 0"), odd)


@query("table_from_files", "SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM "
       "(SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders)")
def _table_from_files(spark, folder):
    name = f"orders_{uuid.uuid4().hex}"
    path = f"{folder}/orders.parquet"
    rows = table_from_files(spark, [path, path], name)
    total = rows.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"))
    result = spark.createDataFrame([tuple(total.first())], total.schema)
    spark.sql(f"DROP TABLE {name}")
    return result


@query(
    "union_by_name",
    """SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
       FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier""",
)
def _union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
    )
    return append_by_name(customers, suppliers)


SOURCES_SQL = """
WITH registry AS (
  SELECT source, row_number() OVER (ORDER BY source) AS source_id,
         CAST((row_number() OVER (ORDER BY source) - 1) % 2 AS INTEGER) AS label
  FROM (SELECT DISTINCT source FROM documents))
SELECT d.doc_id, d.source, r.source_id, r.label
FROM documents d LEFT JOIN registry r ON d.source = r.source
"""


@query("source_registry", SOURCES_SQL)
def _source_registry(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source")
    names = documents.select(F.col("source").alias("name")).where("name IS NOT NULL").distinct()
    label = ((F.col("source_id") - 1) % 2).cast("int")
    return labelled_sources(documents, "source", numbered_sources(names, label))


@query(
    "query_split_xy",
    """SELECT x.vec_id, x.first_value, y.label FROM
         (SELECT vec_id, embedding[1]::DOUBLE AS first_value FROM embeddings WHERE label >= 5) x
         JOIN (SELECT vec_id, label FROM embeddings) y USING (vec_id)""",
)
def _query_split_xy(spark, folder):
    table(spark, folder, "embeddings").createOrReplaceTempView("embeddings_source")
    text = (
        "SELECT vec_id, CAST(get(embedding, 0) AS DOUBLE) AS first_value, label, vec_id AS row_id"
        " FROM embeddings_source WHERE label >= 5;"
    )
    features, labels = query_frame(spark, text, ["label", "row_id"])
    return features.join(labels, F.col("vec_id") == F.col("row_id")).drop("row_id")


@query(
    "glue_blocks",
    """SELECT p_partkey, p_size, p_retailprice, p_brand,
         (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS id FROM part""",
)
def _glue_blocks(spark, folder):
    part = table(spark, folder, "part")
    blocks = [part.select("p_partkey", c) for c in ("p_size", "p_retailprice", "p_brand")]
    return glue_blocks(blocks, ["p_partkey"], id_col="id")


@query(
    "conf_to_rows",
    """SELECT o_orderkey, (u.i - 1)::INTEGER AS position,
         CASE u.i WHEN 1 THEN 'total' ELSE 'customer' END AS name,
         CASE u.i WHEN 1 THEN o_totalprice ELSE o_custkey::DOUBLE END AS value
       FROM orders, (VALUES (1), (2)) u(i)""",
)
def _conf_to_rows(spark, folder):
    conf = table(spark, folder, "orders").select(
        "o_orderkey",
        F.lit("total; customer").alias("name"),
        F.concat_ws("; ", F.col("o_totalprice").cast("string"), "o_custkey").alias("value"),
    )
    return conf_to_rows(conf, {"name": "string", "value": "double"}, keep=["o_orderkey"])


REFERENCES_SQL = """
WITH bins AS (
  SELECT c_nationkey, o_orderpriority AS pid, count(*) AS total,
         count(*) FILTER (o_orderstatus = 'F') AS passed,
         count(*) FILTER (o_orderstatus = 'O') AS open
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey::DOUBLE AS et_bin_lower, (c_nationkey + 1)::DOUBLE AS et_bin_upper,
       (c_nationkey % 3)::DOUBLE AS eta_bin_lower, (c_nationkey % 3 + 1)::DOUBLE AS eta_bin_upper,
       pid, 0 AS label, total, passed, 'shipped' AS reference FROM bins
UNION ALL
SELECT c_nationkey::DOUBLE, (c_nationkey + 1)::DOUBLE, (c_nationkey % 3)::DOUBLE,
       (c_nationkey % 3 + 1)::DOUBLE, pid, 1, total, open, 'open' FROM bins
"""


@query("explode_references", REFERENCES_SQL)
def _explode_references(spark, folder):
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    counts = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "o_orderpriority")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("o_orderstatus") == "F").alias("passed"),
            F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        )
    )

    def references(passed: str, name: str):
        value = F.struct("total", F.col(passed).alias("passed"), F.lit(name).alias("reference"))
        return F.map_from_entries(F.collect_list(F.struct("o_orderpriority", value)))

    # one entry per (nation, priority) is left, so a map holds a handful of entries
    files = counts.groupBy("c_nationkey").agg(
        references("passed", "shipped").alias("bkgRef"), references("open", "open").alias("sgnRef")
    )
    edges = F.sequence(F.lit(0), F.lit(25)).cast("array<double>")
    bins = files.select(
        "bkgRef",
        "sgnRef",
        edges.alias("etBins"),
        edges.alias("etaBins"),
        F.col("c_nationkey").alias("etBinIdx"),
        (F.col("c_nationkey") % 3).alias("etaBinIdx"),
    )
    out = explode_references(bins)
    floats = [c for c, t in out.dtypes if t == "float"]
    return out.withColumns({c: F.col(c).cast("double") for c in floats})


@query(
    "open_vector",
    "SELECT vec_id, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS embedding_{i}" for i in range(80))
    + " FROM embeddings",
)
def _open_vector(spark, folder):
    opened = open_vector("embedding", 80)
    rows = table(spark, folder, "embeddings").select("vec_id", *opened)
    return rows.select(
        "vec_id",
        *[F.col(f"embedding_{i}").cast("double").alias(f"embedding_{i}") for i in range(80)],
    )


@query(
    "flatten_struct",
    """SELECT event_id, event_type AS "info.type", value AS "info.reading.value",
         CAST(json_extract(props, '$.k') AS BIGINT) AS "info.reading.k",
         user_id AS "info.users.0" FROM events""",
)
def _flatten_struct(spark, folder):
    packed = table(spark, folder, "events").select(
        "event_id",
        F.struct(
            F.col("event_type").alias("type"),
            F.struct(
                "value", F.get_json_object("props", "$.k").cast("long").alias("k")
            ).alias("reading"),
            F.array("user_id").alias("users"),
        ).alias("info"),
    )
    return flatten_columns(packed, {"info.users": 1})


@query(
    "unflatten_struct",
    """SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation""",
)
def _unflatten_struct(spark, folder):
    dotted = table(spark, folder, "nation").select(
        "n_nationkey",
        F.col("n_name").alias("nation.name"),
        F.col("n_regionkey").alias("nation.place.region"),
    )
    packed = unflatten_columns(dotted)
    return packed.select("n_nationkey", "nation.name", "nation.place.region")


@query(
    "cast_features",
    """SELECT l_orderkey, l_quantity::FLOAT::DOUBLE AS f0, l_extendedprice::FLOAT::DOUBLE AS f1,
         l_linenumber::BIGINT AS l_linenumber
       FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _cast_features(spark, folder):
    lines = table(spark, folder, "lineitem")
    chosen = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    typed = cast_features(
        lines,
        ["l_quantity", "l_extendedprice"],
        ["l_linenumber"],
        ids=chosen.select(F.col("o_orderkey").alias("l_orderkey")),
        id_col="l_orderkey",
    )
    return typed.select(
        "l_orderkey",
        F.get("features", F.lit(0)).cast("double").alias("f0"),
        F.get("features", F.lit(1)).cast("double").alias("f1"),
        "l_linenumber",
    )


@query(
    "tag_and_filter",
    """SELECT * FROM (
         SELECT o_orderkey, o_totalprice,
                (row_number() OVER (ORDER BY o_orderkey) - 1 + 1000)::BIGINT AS id, 1 AS label
         FROM orders) WHERE o_totalprice >= 200000""",
)
def _tag_and_filter(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return tag_and_filter(orders, 1, ["o_orderkey"], "o_totalprice >= 200000", id_offset=1000)


_SAMPLING_CASE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in SAMPLING_NAMES.items())


@query(
    "enum_lookup",
    f"SELECT p_partkey, p_size, CASE p_size {_SAMPLING_CASE} END AS sampling FROM part",
)
def _enum_lookup(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", "p_size", code_to_name("p_size", SAMPLING_NAMES).alias("sampling")
    )


@query(
    "decode_params",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN props END AS text,
         event_type <> 'error' AS is_json,
         CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k
       FROM events""",
)
def _decode_params(spark, folder):
    raw = F.when(F.col("event_type") == "error", "None").otherwise(F.col("props"))
    rows = table(spark, folder, "events").select("event_id", decode_param(raw).alias("_p"))
    return rows.select("event_id", "_p.text", "_p.is_json", F.col("_p.json")["k"].alias("k"))


@query(
    "run_records",
    """SELECT user_id, max(value) FILTER (event_type = 'click') AS "metric.click",
         max(value) FILTER (event_type = 'purchase') AS "metric.purchase",
         max(value) FILTER (event_type = 'signup') AS "metric.signup",
         max(value) FILTER (event_type = 'view') AS "metric.view",
         max(value) FILTER (event_type = 'error') AS "tag.error"
       FROM events GROUP BY user_id""",
)
def _run_records(spark, folder):
    kind = F.when(F.col("event_type") == "error", "tag").otherwise("metric")
    events = table(spark, folder, "events").withColumn("kind", kind)
    kinds = collect_bounded(events.select("kind", "event_type").distinct(), 1000, "kinds of events")
    names = {k: sorted(r["event_type"] for r in kinds if r["kind"] == k) for k in ("metric", "tag")}
    return run_records(events, ["user_id"], "kind", "event_type", "value", names)


@query(
    "sanitize_names",
    r"""SELECT p_partkey, translate(replace(p_name, ' ', '-') || '.root', '-.', '__') AS name,
         regexp_replace(p_name || '.root.' || p_size, '\.root\.([0-9]+)$', '.\1.root') AS moved
       FROM part""",
)
def _sanitize_names(spark, folder):
    part = table(spark, folder, "part")
    dashed = F.concat(F.translate("p_name", " ", "-"), F.lit(".root"))
    numbered = F.concat("p_name", F.lit(".root."), F.col("p_size").cast("string"))
    return part.select(
        "p_partkey",
        identifier(dashed).alias("name"),
        run_number_before_extension(numbered).alias("moved"),
    )


@query(
    "sql_functions",
    f"""WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
       SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
         round((l_quantity - p.m) / p.s, 6) AS scaled,
         round(sqrt(pow({eta_sql("l_partkey")} - {eta_sql("l_suppkey")}, 2) + pow(0.25, 2)), 6) AS dr
       FROM lineitem, p""",
)
def _sql_functions(spark, folder):
    register_functions(spark)
    lines = table(spark, folder, "lineitem")
    lines = lines.withColumns({"eta1": eta("l_partkey"), "eta2": eta("l_suppkey")})
    lines.createOrReplaceTempView("lines_source")
    p = scaling_params(spark, "lines_source", "^l_quantity$").first()
    rows = spark.sql(
        "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,"
        " standard_scaler(l_quantity, :mean, :std) AS scaled,"
        " delta_r(eta1, 0D, eta2, 0.25D) AS dr FROM lines_source",
        args={"mean": p["avg_l_quantity"], "std": p["std_l_quantity"]},
    )
    return rounded(rows, 6, "scaled", "dr")


_ANY_TABLE = " UNION ALL ".join(
    f"SELECT '{t}' AS source, '{c}' AS name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6)"
    f" AS std FROM {t}"
    for t, columns in (
        ("lineitem", ("l_quantity", "l_extendedprice", "l_tax", "l_linenumber")),
        ("orders", ("o_custkey", "o_totalprice")),
    )
    for c in columns
)


@query("sql_scaling_params", _ANY_TABLE)
def _sql_scaling_params(spark, folder):
    """The same SQL statement over two tables with different columns."""
    register_functions(spark)
    parts = []
    for name, pattern in (
        ("lineitem", "^l_(quantity|extendedprice|tax|linenumber)$"),
        ("orders", "^o_(custkey|totalprice)$"),
    ):
        table(spark, folder, name).createOrReplaceTempView(f"{name}_source")
        found = spark.sql(
            f"EXECUTE IMMEDIATE scaling_params USING '{name}_source' AS source, '{pattern}' AS pattern"
        )
        parts.append(found.select(F.lit(name).alias("source"), "name", "mean", "std"))
    return rounded(parts[0].unionByName(parts[1]), 6, "mean", "std")
