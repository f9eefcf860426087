"""Filters, folds, scaling and joins on labelled samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions.physics import between, delta_r, in_box, standard_score
from calorix.functions.vectors import all_within, l1_norm, l1_normalise
from calorix.operators import folds as fo
from calorix.operators.samples import paired, pairing_counts, validity_counts, write_back
from calorix.operators.scaling import fold_scaling_params, scaling_params, standard_scale
from calorix.plans.base import eta, eta_sql, phi, phi_sql, query, rounded, table

FOLD = "(vec_id % 6 - 1)"


def folded(spark, folder):
    """Embeddings with a fold in -1..4, where -1 stands outside the study."""
    return table(spark, folder, "embeddings").withColumn("fold", (F.col("vec_id") % 6 - 1))


@query(
    "sql_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE abs(l_quantity - 25) <= 5 AND l_extendedprice >= 15000""",
)
def _sql_filter(spark, folder):
    lines = table(spark, folder, "lineitem")
    kept = lines.where(F.expr("abs(l_quantity - 25) <= 5 and l_extendedprice >= 15000"))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "fold_split",
    f"""SELECT vec_id, 'train' AS part FROM embeddings WHERE {FOLD} <> 2 AND {FOLD} >= 0
        UNION ALL SELECT vec_id, 'val' FROM embeddings WHERE {FOLD} = 2
        UNION ALL SELECT vec_id, 'predict' FROM embeddings WHERE {FOLD} >= 0""",
)
def _fold_split(spark, folder):
    rows = folded(spark, folder).select("vec_id", "fold")
    parts = {
        "train": fo.train_rows(rows, 2),
        "val": fo.validation_rows(rows, 2),
        "predict": fo.study_rows(rows),
    }
    tagged = [df.select("vec_id", F.lit(name).alias("part")) for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "kfold_tagged",
    f"""SELECT s.split, is_val, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM (
          SELECT vec_id, s.split, {FOLD} = s.split AS is_val FROM embeddings,
            (SELECT DISTINCT {FOLD} AS split FROM embeddings) s) s GROUP BY ALL""",
)
def _kfold_tagged(spark, folder):
    rows = fo.all_splits(folded(spark, folder).select("vec_id", "fold"))
    return rows.groupBy(F.col("split").cast("long").alias("split"), "is_val").agg(
        F.count("*").alias("n"), F.sum("vec_id").alias("ids")
    )


@query(
    "between_modes",
    """SELECT count(*) FILTER (l_quantity >= 10 AND l_quantity <= 20) AS n_both,
         count(*) FILTER (l_quantity > 10 AND l_quantity < 20) AS n_neither,
         count(*) FILTER (l_quantity >= 10 AND l_quantity < 20) AS n_left,
         count(*) FILTER (l_quantity > 10 AND l_quantity <= 20) AS n_right FROM lineitem""",
)
def _between_modes(spark, folder):
    modes = ("both", "neither", "left", "right")
    return table(spark, folder, "lineitem").agg(
        *[F.count_if(between("l_quantity", 10, 20, m)).alias(f"n_{m}") for m in modes]
    )


@query(
    "validity_counts",
    """WITH v AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_extendedprice / l_quantity END AS r
                  FROM lineitem)
       SELECT count(*) AS n_samples, count(*) FILTER (r > 1000 AND r < 1500) AS n_valid,
         count(*) FILTER (r >= 1500) AS n_over, count(*) FILTER (r <= 1000) AS n_under,
         count(*) FILTER (r IS NULL) AS n_null FROM v""",
)
def _validity_counts(spark, folder):
    ratio = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / F.col("l_quantity"))
    return validity_counts(table(spark, folder, "lineitem"), ratio, 1000, 1500)


@query(
    "vector_in_range",
    """SELECT vec_id, label FROM embeddings
       WHERE list_max(list_transform(embedding, lambda x: abs(x))) <= 0.35""",
)
def _vector_in_range(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.where(all_within("embedding", 0.35)).select("vec_id", "label")


@query(
    "particle_in_box",
    f"""SELECT l_linenumber, count(*) AS n, count(*) FILTER (
          abs({eta_sql("l_partkey")} - {eta_sql("l_suppkey")}) < 0.5
          AND abs({phi_sql("l_partkey")} - {phi_sql("l_suppkey")}) < 0.8) AS n_inside
        FROM lineitem GROUP BY 1""",
)
def _particle_in_box(spark, folder):
    inside = in_box(
        eta("l_partkey"),
        phi("l_partkey"),
        eta("l_suppkey"),
        phi("l_suppkey"),
        F.lit(0.5),
        F.lit(0.8),
    )
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("n_inside")
    )


@query(
    "delta_r",
    f"""WITH d AS (SELECT event_id, abs({eta_sql("event_id")} - {eta_sql("user_id")}) AS de,
               abs({phi_sql("event_id")} - {phi_sql("user_id")}) AS dp FROM events)
        SELECT event_id, round(sqrt(de * de + pow(CASE WHEN dp >= pi() THEN 2 * pi() - dp
          ELSE dp END, 2)), 6) AS delta_r FROM d""",
)
def _delta_r(spark, folder):
    gap = delta_r(eta("event_id"), phi("event_id"), eta("user_id"), phi("user_id"))
    return table(spark, folder, "events").select("event_id", F.round(gap, 6).alias("delta_r"))


@query(
    "class_weights",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
       SELECT label, n AS n_samples,
         (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c""",
)
def _class_weights(spark, folder):
    return fo.class_weights(table(spark, folder, "embeddings"))


@query(
    "class_weights_filtered",
    """WITH c AS (SELECT quality AS label, count(*) AS n FROM labels WHERE toxic = 0 GROUP BY 1)
       SELECT label, n AS n_samples,
         (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c""",
)
def _class_weights_filtered(spark, folder):
    return fo.class_weights(table(spark, folder, "labels"), "quality", "toxic = 0")


@query(
    "stratified_kfold",
    """SELECT vec_id, label, CAST((row_number() OVER (ORDER BY label,
           md5('42|' || vec_id), vec_id) - 1) % 5 AS TINYINT) AS fold FROM embeddings""",
)
def _stratified_kfold(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return fo.stratified_kfold(rows, 5, id_col="vec_id", seed=42)


@query(
    "stratified_kfold_filtered",
    """WITH k AS (SELECT doc_id, (row_number() OVER (ORDER BY quality, doc_id) - 1) % 3 AS fold
                  FROM labels WHERE toxic = 0)
       SELECT l.doc_id, l.quality, coalesce(k.fold, -1)::BIGINT AS fold
       FROM labels l LEFT JOIN k USING (doc_id)""",
)
def _stratified_kfold_filtered(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    dealt = fo.stratified_kfold(
        rows, 3, "doc_id", "quality", shuffle=False, filter_cond="toxic = 0"
    )
    fold = F.coalesce(F.col("fold").cast("long"), F.lit(-1)).alias("fold")
    return dealt.select("doc_id", "quality", fold)


@query(
    "fold_write_back",
    """SELECT o_orderkey, o_custkey, (l.n % 5)::DOUBLE AS fold FROM orders
       LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l
         ON l_orderkey = o_orderkey""",
)
def _fold_write_back(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    updates = lines.agg((F.count("*") % 5).cast("double").alias("fold"))
    return write_back(orders, updates, "o_orderkey", "fold")


@query(
    "head_fraction",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM (
         SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber,
             l_partkey, l_suppkey, l_quantity) AS r,
           count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
       WHERE r <= floor(n * 0.3)""",
)
def _head_fraction(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = table(spark, folder, "lineitem").select(*keys, "l_returnflag")
    head = fo.head_fraction(lines, ["l_returnflag"], keys, 0.3)
    return head.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")


@query(
    "scaling_params_pop",
    """SELECT round(avg(l_quantity), 6) AS avg_l_quantity,
         round(stddev_pop(l_quantity), 6) AS std_l_quantity,
         round(avg(l_extendedprice), 3) AS avg_l_extendedprice,
         round(stddev_pop(l_extendedprice), 3) AS std_l_extendedprice FROM lineitem""",
)
def _scaling_params_pop(spark, folder):
    out = scaling_params(table(spark, folder, "lineitem"), "^l_(quantity|extendedprice)$")
    small = ["avg_l_quantity", "std_l_quantity"]
    return rounded(rounded(out, 6, *small), 3, *[c for c in out.columns if c not in small])


@query(
    "scaling_params_fold",
    f"""SELECT round(avg(l_quantity), 6) AS avg_l_quantity,
         round(stddev_samp(l_quantity), 6) AS std_l_quantity,
         round(avg(abs({eta_sql("l_partkey")})), 6) AS avg_eta,
         round(stddev_samp(abs({eta_sql("l_partkey")})), 6) AS std_eta
       FROM lineitem WHERE l_orderkey % 6 - 1 <> 1 AND l_orderkey % 6 - 1 >= 0""",
)
def _scaling_params_fold(spark, folder):
    lines = table(spark, folder, "lineitem").withColumns(
        {"eta": eta("l_partkey"), "fold": F.col("l_orderkey") % 6 - 1}
    )
    out = fold_scaling_params(lines, 1, ["l_quantity", "eta"], absolute=["eta"])
    return rounded(out, 6, *out.columns)


@query(
    "standard_scale",
    """WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
       SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, p""",
)
def _standard_scale(spark, folder):
    lines = table(spark, folder, "lineitem")
    params = scaling_params(lines, ["l_quantity"]).first().asDict()
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    scaled = standard_scale(lines.select(*keys, "l_quantity"), params, ["l_quantity"])
    return rounded(scaled, 6, "l_quantity")


@query(
    "constant_scale",
    """SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_quantity = 1) AS n_null
       FROM lineitem GROUP BY l_linenumber""",
)
def _constant_scale(spark, folder):
    score = standard_score(F.col("l_quantity"), F.lit(0.0), F.col("l_quantity") - 1)
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(score.isNull()).alias("n_null")
    )


@query(
    "ring_norm",
    """WITH n AS (SELECT vec_id, embedding,
           abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) AS s FROM embeddings),
       d AS (SELECT *, CASE WHEN s = 0 THEN 1 ELSE s END AS norm FROM n)
       SELECT vec_id, round(norm, 6) AS norm, (i - 1)::INTEGER AS position,
         round(embedding[i]::DOUBLE / norm, 4) + 0.0::DOUBLE AS ring
       FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM d)""",
)
def _ring_norm(spark, folder):
    rings = table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(l1_norm("embedding"), 6).alias("norm"),
        F.posexplode(l1_normalise("embedding")).alias("position", "ring"),
    )
    return rings.withColumn("ring", F.round("ring", 4))


@query(
    "paired_predictions",
    """SELECT o_orderkey, CAST(o_totalprice >= 250000 AS INTEGER) AS predicted_label,
         CAST(n >= 4 AS INTEGER) AS predicted_label_lines
       FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey""",
)
def _paired_predictions(spark, folder):
    left, right = prediction_pair(spark, folder)
    return paired(left, right, "o_orderkey", "_lines", ["predicted_label"])


def prediction_pair(spark, folder):
    """Two labellings of orders: by price, and by number of lines."""
    by_price = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") >= 250000).cast("int").alias("predicted_label")
    )
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    by_lines = lines.agg((F.count("*") >= 4).cast("int").alias("predicted_label"))
    return by_price, by_lines


@query(
    "pairing_counts",
    """WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
       SELECT count(*) FILTER (o_orderkey IS NOT NULL AND k IS NOT NULL) AS n_both,
         count(*) FILTER (k IS NULL) AS n_left_only,
         count(*) FILTER (o_orderkey IS NULL) AS n_right_only
       FROM orders FULL JOIN l ON o_orderkey = k""",
)
def _pairing_counts(spark, folder):
    return pairing_counts(*prediction_pair(spark, folder), "o_orderkey")
