"""Nested-event queries: orders are events, their lines fill every container."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from calorix.operators import nested
from calorix.operators.profile import energy_ratio
from calorix.operators.samples import event_samples, size_violations, unmatched_keys
from calorix.plans.base import eta, eta_sql, phi, phi_sql, query, table
from calorix.schemas import EVENT_SCHEMA
from calorix.session import checkpoint_root, durable
from calorix.sources.readers import event_scan
from calorix.sources.writers import write_gzip

LINE_FIELDS = (
    "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax".split()
)


def nested_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_FIELDS)
    return nested.nest_rows(lines, ["l_orderkey"], LINE_FIELDS)


def _angle(of: Column, factor: int, period: int, shift: float) -> Column:
    return (of * factor) % period / F.lit(1000.0) - F.lit(shift)


def _direction(line: Column) -> dict[str, Column]:
    return {
        "eta": _angle(line["l_partkey"], 37, 5001, 2.5),
        "phi": _angle(line["l_partkey"], 73, 6284, 3.142),
    }


# Element fields that have a stand-in, per container; a reader fills the others with NULL.
ELEMENTS = {
    nested.CELLS: lambda x: {"descriptor_link": x["l_partkey"], "e": x["l_quantity"]},
    nested.CLUSTERS: lambda x: {
        "cell_links": F.array(x["l_partkey"], x["l_partkey"] + 1),
        "e": x["l_quantity"],
        "et": x["l_extendedprice"],
        "seed_link": x["l_linenumber"] - 1,
        **_direction(x),
    },
    nested.DESCRIPTORS: lambda x: {
        "hash": x["l_partkey"] + x["l_linenumber"] % 3,
        "e": x["l_quantity"],
    },
    nested.RINGS: lambda x: {
        "cluster_link": x["l_linenumber"] - 1,
        "rings": F.array(x["l_quantity"], x["l_discount"], x["l_tax"]),
    },
    nested.ELECTRONS: lambda x: {"cluster_link": x["l_linenumber"], "e": x["l_quantity"]},
    nested.SEEDS: lambda x: {"id": x["l_suppkey"] % 5, "e": x["l_quantity"], **_direction(x)},
    nested.PARTICLES: lambda x: {
        "seedid": (x["l_suppkey"] + x["l_linenumber"]) % 7,
        "e": x["l_quantity"],
    },
}


def _container(name: str) -> Column:
    types = EVENT_SCHEMA[name].dataType.elementType

    def build(line: Column) -> Column:
        given = ELEMENTS[name](line)
        return F.struct(*[v.cast(types[f].dataType).alias(f) for f, v in given.items()])

    return F.transform("items", build).alias(name)


def nested_events(spark: SparkSession, folder: str, *containers: str) -> DataFrame:
    """Orders in the nested event format, plus ``event_id``; all containers by default."""
    event = F.struct(
        (F.col("l_orderkey") % 60).cast("float").alias("avgmu"),
        F.col("l_orderkey").cast("float").alias("eventNumber"),
        F.lit(1.0).cast("float").alias("runNumber"),
    )
    names = containers or (*ELEMENTS, nested.INFO)
    return nested_lines(spark, folder).select(
        F.col("l_orderkey").alias("event_id"),
        *[F.array(event).alias(n) if n == nested.INFO else _container(n) for n in names],
    )


def stored_events(spark: SparkSession, folder: str, *containers: str) -> DataFrame:
    """Nested events written once and read under the full event schema."""
    events = nested_events(spark, folder, *containers)
    schema = StructType([events.schema["event_id"], *EVENT_SCHEMA.fields])
    return durable(events, "events", schema)


# Lines with their position in the event, as the SQL side sees them.
ITEMS = """
items AS (
  SELECT l_orderkey AS event_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         l_quantity AS q, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
           l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS pos,
         CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n
  FROM lineitem)
"""


@query(
    "event_scan",
    f"""WITH {ITEMS}
    SELECT event_id AS event_number, CAST(max(n) AS INTEGER) AS n_clusters,
           sum(CAST(q AS BIGINT))::BIGINT AS cluster_e
    FROM items GROUP BY event_id""",
)
def _event_scan(spark, folder):
    path = f"{checkpoint_root(spark)}/events-{uuid.uuid4().hex}"
    written = nested_events(spark, folder, nested.CLUSTERS, nested.SEEDS, nested.INFO)
    write_gzip(written.drop("event_id"), path)
    events = event_scan(spark, [path], skip_corrupt=True)
    total = F.aggregate(
        F.col(f"{nested.CLUSTERS}.e"), F.lit(0.0), lambda s, x: s + x.cast("double")
    )
    return events.select(
        F.get(F.col(f"{nested.INFO}.eventNumber"), F.lit(0)).cast("long").alias("event_number"),
        F.size(nested.CLUSTERS).alias("n_clusters"),
        total.cast("long").alias("cluster_e"),
    )


@query(
    "event_ids",
    """SELECT count(*) AS n_events, count(*) AS n_ids, 1::BIGINT AS first_id, count(*) AS last_id
       FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
)
def _event_ids(spark, folder):
    events = nested_events(spark, folder, nested.INFO).drop("event_id")
    return nested.with_event_ids(events).agg(
        F.count("*").alias("n_events"),
        F.count_distinct("event_id").alias("n_ids"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


#: Elements of a part where a query shows keys in parts; a small number, so that all have some.
PART = 3


@query(
    "nest_events",
    f"""WITH {ITEMS}
    SELECT event_id AS l_orderkey, (pos - pos % {PART})::BIGINT AS first_pos,
         CAST(count(*) AS INTEGER) AS n_items, sum(ln)::BIGINT AS linenumbers,
         arg_min(pk, pos) AS first_partkey
       FROM items GROUP BY 1, 2""",
)
def _nest_events(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_FIELDS)
    return nested.nest_rows(lines, ["l_orderkey"], LINE_FIELDS, part_size=PART).select(
        "l_orderkey",
        "first_pos",
        F.size("items").alias("n_items"),
        F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["l_linenumber"]).alias(
            "linenumbers"
        ),
        F.get("items", F.lit(0))["l_partkey"].alias("first_partkey"),
    )


@query(
    "flatten_children",
    f"""WITH {ITEMS}
    SELECT event_id, pos::BIGINT AS pos, pk AS l_partkey, sk AS l_suppkey, q AS l_quantity,
           price AS l_extendedprice
    FROM items""",
)
def _flatten_children(spark, folder):
    lines = nested_lines(spark, folder).withColumnRenamed("l_orderkey", "event_id")
    flat = nested.explode_children(lines, ["event_id"], "items", first_col="first_pos")
    return flat.select(
        "event_id", "pos", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


@query(
    "link_by_position",
    f"""WITH {ITEMS}
    SELECT c.event_id, c.pos, s.pos::DOUBLE AS seed_pos, {eta_sql("s.pk")} AS seed_eta
    FROM items c LEFT JOIN items s ON s.event_id = c.event_id AND s.pos = c.ln - 1""",
)
def _link_by_position(spark, folder):
    events = nested_lines(spark, folder)
    linked = F.transform(
        "items",
        lambda c: F.struct(
            nested.valid_position(c["l_linenumber"] - 1, F.col("items")).alias("seed_pos"),
            nested.link_by_position(c["l_linenumber"] - 1, F.col("items"))["l_partkey"].alias("pk"),
        ),
    )
    rows = events.select(
        F.col("l_orderkey").alias("event_id"), F.posexplode(linked).alias("pos", "_c")
    ).select("event_id", "pos", "_c.*")
    seed = F.col("seed_pos").cast("double").alias("seed_pos")
    return rows.select("event_id", "pos", seed, eta("pk").alias("seed_eta"))


@query(
    "link_by_hash_last",
    f"""WITH {ITEMS},
    links AS (
      SELECT event_id, hash, max(pos) AS cluster_pos
      FROM (SELECT event_id, pos, pk AS hash FROM items
            UNION ALL SELECT event_id, pos, pk + 1 FROM items) GROUP BY event_id, hash)
    SELECT d.event_id, d.pos, d.pk + d.ln % 3 AS hash, l.cluster_pos::DOUBLE AS cluster_pos
    FROM items d LEFT JOIN links l ON l.event_id = d.event_id AND l.hash = d.pk + d.ln % 3""",
)
def _link_by_hash_last(spark, folder):
    events = stored_events(spark, folder, nested.DESCRIPTORS, nested.CLUSTERS)
    return nested.descriptor_table(events).select(
        "event_id", "pos", "hash", F.col("cluster_pos").cast("double").alias("cluster_pos")
    )


@query(
    "link_cell_to_descriptor",
    f"""WITH {ITEMS},
    links AS (SELECT event_id, pk + ln % 3 AS hash, max(pos) AS descriptor_pos
              FROM items GROUP BY 1, 2)
    SELECT c.event_id, c.pos, l.descriptor_pos::DOUBLE AS descriptor_pos
    FROM items c LEFT JOIN links l ON l.event_id = c.event_id AND l.hash = c.pk""",
)
def _link_cell(spark, folder):
    events = stored_events(spark, folder, nested.CELLS, nested.DESCRIPTORS)
    return nested.cell_table(events).select(
        "event_id", "pos", F.col("descriptor_pos").cast("double").alias("descriptor_pos")
    )


@query(
    "first_match_or_empty",
    f"""WITH {ITEMS},
    firsts AS (SELECT event_id, ln - 1 AS cluster_pos, min(pos) AS ring_pos FROM items GROUP BY 1, 2)
    SELECT c.event_id, c.pos, CASE WHEN f.ring_pos IS NULL THEN 0 ELSE 3 END AS rings_size,
           CAST(CAST(r.q AS FLOAT) AS DOUBLE) AS ring_0
    FROM items c
    LEFT JOIN firsts f ON f.event_id = c.event_id AND f.cluster_pos = c.pos
    LEFT JOIN items r ON r.event_id = f.event_id AND r.pos = f.ring_pos""",
)
def _first_match(spark, folder):
    return nested.cluster_table(
        nested_events(spark, folder, nested.CLUSTERS, nested.SEEDS, nested.RINGS)
    ).select(
        "event_id",
        "pos",
        F.size("rings").alias("rings_size"),
        F.get("rings", F.lit(0)).cast("double").alias("ring_0"),
    )


@query(
    "link_nullable",
    f"""WITH {ITEMS}
    SELECT event_id, pos, (CASE WHEN ln < n THEN ln END)::DOUBLE AS cluster_pos
    FROM items""",
)
def _link_nullable(spark, folder):
    return nested.electron_table(
        nested_events(spark, folder, nested.ELECTRONS, nested.CLUSTERS)
    ).select(
        "event_id", "pos", F.col("cluster_pos").cast("double").alias("cluster_pos")
    )


@query(
    "link_by_key",
    f"""WITH {ITEMS},
    seeds AS (SELECT event_id, sk % 5 AS sid, max(pos) AS seed_pos FROM items GROUP BY 1, 2)
    SELECT p.event_id, p.pos, s.seed_pos::DOUBLE AS seed_pos
    FROM items p LEFT JOIN seeds s ON s.event_id = p.event_id AND s.sid = (p.sk + p.ln) % 7""",
)
def _link_by_key(spark, folder):
    events = stored_events(spark, folder, nested.PARTICLES, nested.SEEDS)
    return nested.particle_table(events).select(
        "event_id", "pos", F.col("seed_pos").cast("double").alias("seed_pos")
    )


@query(
    "dense_keys",
    f"""WITH {ITEMS},
    ids AS (SELECT *, row_number() OVER (ORDER BY event_id, pos) AS id FROM items)
    SELECT c.event_id, c.id, s.id::DOUBLE AS seed_id, CAST(CAST(c.q AS FLOAT) AS DOUBLE) AS e
    FROM ids c LEFT JOIN ids s ON s.event_id = c.event_id AND s.pos = c.ln - 1""",
)
def _dense_keys(spark, folder):
    events = stored_events(spark, folder, nested.CLUSTERS, nested.SEEDS, nested.RINGS)
    tables = {
        "clusters": nested.cluster_table(events).select("event_id", "pos", "seed_pos", "e"),
        "seeds": nested.seed_table(events).select("event_id", "pos"),
    }
    clusters = nested.with_dense_keys(tables, ["clusters"])["clusters"]
    return clusters.select(
        "event_id",
        "id",
        F.col("seed_id").cast("double").alias("seed_id"),
        F.col("e").cast("double").alias("e"),
    )


@query(
    "dangling_links",
    f"""WITH {ITEMS},
    cl AS (SELECT DISTINCT event_id, hash FROM (
             SELECT event_id, pk AS hash FROM items UNION ALL SELECT event_id, pk + 1 FROM items)),
    de AS (SELECT DISTINCT event_id, pk + ln % 3 AS hash FROM items),
    se AS (SELECT DISTINCT event_id, sk % 5 AS sid FROM items)
    SELECT 'clusters' AS "table", 'seed_pos' AS link, count(*) AS n_rows,
           count(*) FILTER (ln - 1 >= n) AS n_dangling FROM items
    UNION ALL SELECT 'electrons', 'cluster_pos', count(*), count(*) FILTER (ln >= n) FROM items
    UNION ALL SELECT 'calo_descriptor_cells', 'cluster_pos', count(*), count(*) FILTER (
      NOT EXISTS (SELECT 1 FROM cl WHERE cl.event_id = i.event_id AND cl.hash = i.pk + i.ln % 3))
      FROM items i
    UNION ALL SELECT 'calo_cells', 'descriptor_pos', count(*), count(*) FILTER (
      NOT EXISTS (SELECT 1 FROM de WHERE de.event_id = i.event_id AND de.hash = i.pk)) FROM items i
    UNION ALL SELECT 'truth_particles', 'seed_pos', count(*), count(*) FILTER (
      NOT EXISTS (SELECT 1 FROM se WHERE se.event_id = i.event_id AND se.sid = (i.sk + i.ln) % 7))
      FROM items i""",
)
def _dangling_links(spark, folder):
    return nested.dangling_links(nested.child_tables(stored_events(spark, folder)))


@query(
    "ring_records",
    f"""WITH {ITEMS}
    SELECT r.event_id, r.pos AS ring_pos, 3 AS rings_size,
           round(CAST(CAST({eta_sql("c.pk")} AS FLOAT) AS DOUBLE), 6) AS cl_eta,
           round(CAST(CAST({phi_sql("c.pk")} AS FLOAT) AS DOUBLE), 6) AS cl_phi,
           CAST(CAST(r.q AS FLOAT) AS DOUBLE) AS ring_0
    FROM items r JOIN items c ON c.event_id = r.event_id AND c.pos = r.ln - 1""",
)
def _ring_records(spark, folder):
    records = nested.ring_records(
        nested_events(spark, folder, nested.RINGS, nested.CLUSTERS), n_rings=1
    )
    return records.select(
        "event_id",
        "ring_pos",
        "rings_size",
        F.round(F.col("cl_eta").cast("double"), 6).alias("cl_eta"),
        F.round(F.col("cl_phi").cast("double"), 6).alias("cl_phi"),
        F.col("ring_0").cast("double").alias("ring_0"),
    )


@query(
    "skipped_ring_sets",
    f"""WITH {ITEMS}
    SELECT count(*) AS n_ring_sets, count(*) FILTER (ln - 1 >= n) AS n_skipped FROM items""",
)
def _skipped(spark, folder):
    return nested.skipped_ring_sets(
        nested_events(spark, folder, nested.RINGS, nested.CLUSTERS)
    )


@query(
    "event_info_check",
    """SELECT count(*) AS n_events, 0::BIGINT AS n_without_one_info
       FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
)
def _event_info_check(spark, folder):
    events = nested_events(spark, folder, nested.INFO)
    bad = size_violations(events, nested.INFO)
    return events.agg(F.count("*").alias("n_events")).withColumn(
        "n_without_one_info", F.lit(bad.count())
    )


@query(
    "fk_violations",
    """SELECT 'lineitem.order' AS "check", count(*) AS n_violations FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
       UNION ALL SELECT 'order.lineitem', count(*) FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
       UNION ALL SELECT 'order.customer', count(*) FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)""",
)
def _fk_violations(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey")
    checks = [
        unmatched_keys(lines, orders, {"l_orderkey": "o_orderkey"}, "lineitem.order"),
        unmatched_keys(orders, lines, {"o_orderkey": "l_orderkey"}, "order.lineitem"),
        unmatched_keys(orders, customers, {"o_custkey": "c_custkey"}, "order.customer"),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query(
    "dense_ids",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_discount, l_tax) AS id
       FROM lineitem""",
)
def _dense_ids(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINE_FIELDS)
    numbered = nested.with_dense_ids(lines, ["l_orderkey", *LINE_FIELDS])
    return numbered.drop("l_discount", "l_tax")


@query(
    "build_samples",
    f"""WITH {ITEMS}, samples AS (
      SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS source_id, event_id,
             pos AS cluster_id, CAST(CAST(event_id AS FLOAT) AS DOUBLE) AS event_number,
             CAST(event_id % 60 AS DOUBLE) AS avgmu, CAST(CAST(price AS FLOAT) AS DOUBLE) AS cl_et,
             CAST(CAST({eta_sql("pk")} AS FLOAT) AS DOUBLE) AS cl_eta, event_id % 2 AS label
      FROM items)
    SELECT source_id, event_id, cluster_id, event_number, avgmu, round(cl_et, 2) AS cl_et,
           round(cl_eta, 6) AS cl_eta, CAST(label AS TINYINT) AS label FROM samples""",
)
def _build_samples(spark, folder):
    containers = (nested.CLUSTERS, nested.SEEDS, nested.RINGS, nested.INFO)
    parity = F.col("event_id") % 2
    samples = event_samples(stored_events(spark, folder, *containers), parity + 1, parity)
    return samples.select(
        "source_id",
        "event_id",
        "cluster_id",
        F.col("eventNumber").cast("double").alias("event_number"),
        F.col("avgmu").cast("double").alias("avgmu"),
        F.round(F.col("cl_et").cast("double"), 2).alias("cl_et"),
        F.round(F.col("cl_eta").cast("double"), 6).alias("cl_eta"),
        "label",
    )


ENERGY_RATIO_SQL = f"""
WITH seeds AS (
  SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey),
clusters AS (
  SELECT o_orderkey AS id, o_orderkey AS seed_id, o_totalprice AS et, o_totalprice * 2 AS e,
         {eta_sql("o_orderkey")} AS eta, {phi_sql("o_orderkey")} AS phi, 1.0 AS deta, 1.5 AS dphi
  FROM orders),
particles AS (
  SELECT row_number() OVER () AS id, l_orderkey AS seed_id, l_quantity / 1000 AS et,
         l_extendedprice / 1000 AS e, {eta_sql("l_partkey")} AS eta, {phi_sql("l_partkey")} AS phi
  FROM lineitem)
SELECT c.id AS cluster_id, count(DISTINCT c.id) AS n_clusters, max(c.et) AS cl_et,
       max(c.e) AS cl_e, count(DISTINCT s.id) AS n_seeds, count(DISTINCT p.id) AS n_particles,
       count(*) FILTER (abs(p.eta - c.eta) < c.deta AND abs(p.phi - c.phi) < c.dphi) AS in_cluster,
       round(sum(p.et) * 1000, 4) AS total_tp_et,
       round(sum(p.et) * 1000 / max(c.et), 6) AS total_tp_et_cl_et_ratio,
       round(sum(p.e) * 1000, 4) AS total_tp_energy,
       round(sum(p.e) * 1000 / max(c.e), 6) AS total_tp_energy_cl_e_ratio
FROM clusters c JOIN seeds s ON c.seed_id = s.id JOIN particles p ON s.id = p.seed_id
GROUP BY c.id HAVING count(DISTINCT c.id) = 1
"""


@query("energy_ratio", ENERGY_RATIO_SQL)
def energy_ratio_query(spark, folder):
    """Energy behind each cluster: orders are clusters, lines are truth particles."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey")
    lines = table(spark, folder, "lineitem")
    seeds = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id")
    )
    clusters = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("seed_id"),
        F.col("o_totalprice").alias("et"),
        (F.col("o_totalprice") * 2).alias("e"),
        eta("o_orderkey").alias("eta"),
        phi("o_orderkey").alias("phi"),
        F.lit(1.0).alias("deta"),
        F.lit(1.5).alias("dphi"),
    )
    particles = lines.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("l_orderkey").alias("seed_id"),
        (F.col("l_quantity") / 1000).alias("et"),
        (F.col("l_extendedprice") / 1000).alias("e"),
        eta("l_partkey").alias("eta"),
        phi("l_partkey").alias("phi"),
    )
    # the widest box spans 2 by 3
    out = energy_ratio(clusters, seeds, particles, cell=3.1)
    return out.withColumns(
        {
            "total_tp_et": F.round("total_tp_et", 4),
            "total_tp_et_cl_et_ratio": F.round("total_tp_et_cl_et_ratio", 6),
            "total_tp_energy": F.round("total_tp_energy", 4),
            "total_tp_energy_cl_e_ratio": F.round("total_tp_energy_cl_e_ratio", 6),
        }
    )
