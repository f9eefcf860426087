"""Distributions, per-event aggregates and run comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.operators import compare, profile
from calorix.operators.metrics import trapezoid_area
from calorix.session import collect_bounded
from calorix.plans.base import eta, eta_sql, phi, phi_sql, query, rounded, table
from calorix.plans.samples import prediction_pair
from calorix.schemas import LEGAL_RING_SIZES

# Layers of the 64-long stand-in vectors.
LAYERS = (("A", 0, 8), ("B", 8, 24), ("C", 32, 32))


@query(
    "sample_counts",
    "SELECT count(*) AS n_samples, count(DISTINCT l_orderkey) AS n_events FROM lineitem",
)
def _sample_counts(spark, folder):
    return profile.sample_counts(table(spark, folder, "lineitem"), "l_orderkey")


@query(
    "summary_stats",
    """SELECT event_type, count(*) AS n_samples, count(*) FILTER (value IS NULL) AS value_null,
         round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
         min(value) AS value_min, max(value) AS value_max FROM events GROUP BY event_type""",
)
def _summary_stats(spark, folder):
    out = profile.summary(table(spark, folder, "events"), ["value"], by=["event_type"])
    return rounded(out, 6, "value_mean", "value_std")


def _edges_sql(column: str, source: str, nbins: int) -> str:
    return f"""
    b AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
    e AS (SELECT i AS bin, lo + i * ((hi - lo) / {nbins - 1}) AS bin_low,
            CASE WHEN i = {nbins - 2} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {nbins - 1}) END
              AS bin_high
          FROM b, range({nbins - 1}) r(i))"""


@query(
    "histogram",
    f"""WITH {_edges_sql("value", "events", 50)}
    SELECT CAST(bin AS INTEGER) AS bin, round(bin_low, 6) AS bin_low,
      round(bin_high, 6) AS bin_high, count(*) AS n,
      round(count(*) / ((SELECT count(*) FROM events) * (bin_high - bin_low)), 6) AS density
    FROM events JOIN e ON value >= bin_low AND (value < bin_high OR (bin = 48 AND value = bin_high))
    GROUP BY bin, bin_low, bin_high""",
)
def _histogram(spark, folder):
    out = profile.histogram(table(spark, folder, "events"), "value", nbins=50)
    return rounded(out, 6, "bin_low", "bin_high", "density")


@query(
    "histogram_clipped",
    """WITH v AS (SELECT CAST(floor(l_quantity - 10) AS INTEGER) AS b FROM lineitem
                  WHERE l_quantity >= 10 AND l_quantity <= 30)
    SELECT least(b, 19) AS bin, count(*) AS n,
      round(count(*) / (SELECT count(*) FROM v), 6) AS density FROM v GROUP BY 1""",
)
def _histogram_clipped(spark, folder):
    out = profile.histogram(
        table(spark, folder, "lineitem"), "l_quantity", nbins=21, bin_min=10, bin_max=30
    )
    return rounded(out.select("bin", "n", "density"), 6, "density")


@query(
    "histogram_shared",
    f"""WITH {_edges_sql("value", "events WHERE event_type = 'click'", 26)}
    SELECT event_type, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM events
    JOIN e ON value >= bin_low AND (value < bin_high OR (bin = 24 AND value = bin_high))
    GROUP BY event_type, bin""",
)
def _histogram_shared(spark, folder):
    """All event types on the edges that the clicks define."""
    events = table(spark, folder, "events")
    clicks = events.where("event_type = 'click'")
    edges = profile.linear_edges(*profile.value_range(clicks, "value"), 26)
    out = profile.histogram(events, "value", edges=edges, by=["event_type"])
    return out.select("event_type", "bin", "n")


@query(
    "category_pct",
    """SELECT event_type, count(*) AS n,
         round(100 * count(*) / (SELECT count(*) FROM events), 6) AS percent
       FROM events GROUP BY event_type""",
)
def _category_pct(spark, folder):
    out = profile.category_counts(table(spark, folder, "events"), "event_type")
    return rounded(out, 6, "percent")


@query(
    "histogram2d",
    """WITH c AS (
         SELECT least(CAST(floor((l_quantity - 1) / 7) AS INTEGER), 6) AS x_bin,
                least(CAST(floor(l_linenumber - 1) AS INTEGER), 5) AS y_bin, count(*) AS n
         FROM lineitem GROUP BY 1, 2)
       SELECT x_bin, y_bin, n, sum(n) OVER (PARTITION BY x_bin)::BIGINT AS n_x,
         sum(n) OVER (PARTITION BY y_bin)::BIGINT AS n_y,
         round(n / (sum(n) OVER () * 7), 6) AS density FROM c""",
)
def _histogram2d(spark, folder):
    out = profile.histogram2d(
        table(spark, folder, "lineitem"),
        "l_quantity",
        "l_linenumber",
        [1 + 7.0 * i for i in range(8)],
        [1.0 + i for i in range(7)],
    )
    return rounded(out, 6, "density")


@query(
    "vector_profile",
    """WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS position,
                    unnest(embedding)::DOUBLE AS x FROM embeddings)
       SELECT label, CAST(position AS INTEGER) AS position, count(*) AS n,
         round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
         CASE WHEN position < 8 THEN 'A' WHEN position < 32 THEN 'B' ELSE 'C' END AS layer
       FROM p GROUP BY label, position""",
)
def _vector_profile(spark, folder):
    out = profile.vector_profile(
        table(spark, folder, "embeddings"), "embedding", by=["label"], layers=LAYERS
    )
    return rounded(out, 6, "mean", "std")


@query(
    "vector_profile_normalised",
    """WITH s AS (SELECT embedding,
           abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) AS s FROM embeddings),
         p AS (SELECT generate_subscripts(embedding, 1) - 1 AS position,
                 unnest(embedding)::DOUBLE / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM s)
       SELECT CAST(position AS INTEGER) AS position, count(*) AS n, round(avg(x), 3) AS mean
       FROM p GROUP BY position""",
)
def _vector_profile_normalised(spark, folder):
    out = profile.vector_profile(table(spark, folder, "embeddings"), "embedding", normalise=True)
    return rounded(out.select("position", "n", "mean"), 3, "mean")


@query(
    "layer_energy",
    """SELECT vec_id,
         round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS e_a,
         round(list_sum(list_transform(embedding[9:32], lambda x: x::DOUBLE)), 6) AS e_b,
         round(list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) AS e_c
       FROM embeddings""",
)
def _layer_energy(spark, folder):
    out = profile.layer_energy(table(spark, folder, "embeddings"), "embedding", ["vec_id"], LAYERS)
    return rounded(out, 6, "e_a", "e_b", "e_c")


@query(
    "ring_size_counts",
    """SELECT count(*) AS n_samples, count(*) FILTER (n % 7 = 0) AS size_100,
         count(*) FILTER (n % 7 = 1) AS size_18, count(*) FILTER (n % 7 = 2) AS size_0,
         count(*) FILTER (n % 7 > 2) AS wrong, count(*) FILTER (n % 7 = 2) AS no_rings
       FROM (SELECT o_orderkey AS n FROM orders)""",
)
def _ring_size_counts(spark, folder):
    key = F.col("o_orderkey") % 7
    size = F.when(key == 0, 100).when(key == 1, 18).when(key == 2, 0).otherwise(50)
    orders = table(spark, folder, "orders").withColumn("rings", F.array_repeat(F.lit(0.0), size))
    return profile.ring_size_counts(orders, "rings", LEGAL_RING_SIZES)


@query(
    "event_top2",
    f"""WITH e AS (SELECT user_id, event_id, value, {eta_sql("event_id")} AS eta,
             {phi_sql("event_id")} AS phi, event_type FROM events),
       r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
             FROM e),
       t AS (SELECT user_id, max(value) FILTER (r = 1) AS highest_e1,
               max(value) FILTER (r = 2) AS highest_e2, max(eta) FILTER (r = 1) AS eta1,
               max(eta) FILTER (r = 2) AS eta2, max(phi) FILTER (r = 1) AS phi1,
               max(phi) FILTER (r = 2) AS phi2 FROM r GROUP BY user_id),
       c AS (SELECT user_id, count(*) AS n_objects, count(*) - count(DISTINCT
               (event_id, value, event_type)) + 1 AS n_duplicates FROM e GROUP BY user_id)
       SELECT user_id, n_objects, n_duplicates, highest_e1, highest_e2, eta1, eta2, phi1, phi2,
         round(sqrt(pow(eta1 - eta2, 2) + pow(CASE WHEN abs(phi1 - phi2) >= pi()
           THEN 2 * pi() - abs(phi1 - phi2) ELSE abs(phi1 - phi2) END, 2)), 6) AS delta_r
       FROM c JOIN t USING (user_id)""",
)
def _event_top2(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        eta("event_id").alias("eta"),
        phi("event_id").alias("phi"),
    )
    out = profile.event_top2(events, "user_id", "value", "eta", "phi", "event_id", ["event_type"])
    return rounded(out, 6, "delta_r")


@query(
    "event_top2_duplicates",
    """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber DESC) AS r FROM lineitem),
       c AS (SELECT l_orderkey, count(*) AS n_objects,
               count(*) - count(DISTINCT l_linenumber) + 1 AS n_duplicates
             FROM lineitem GROUP BY 1)
       SELECT l_orderkey, n_objects, n_duplicates,
         (max(l_linenumber) FILTER (r = 1))::DOUBLE AS highest_e1,
         (max(l_linenumber) FILTER (r = 2))::DOUBLE AS highest_e2
       FROM c JOIN r USING (l_orderkey) GROUP BY ALL""",
)
def _event_top2_duplicates(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("double").alias("n"), F.lit(0.0).alias("zero")
    )
    out = profile.event_top2(lines, "l_orderkey", "n", "zero", "zero", "n", [])
    return out.select("l_orderkey", "n_objects", "n_duplicates", "highest_e1", "highest_e2")


@query(
    "weighted_stats",
    """WITH m AS (SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS mean
                  FROM lineitem GROUP BY 1)
       SELECT l_returnflag, round(mean, 6) AS weighted_mean,
         round(sqrt(sum(l_quantity * pow(l_discount - mean, 2)) / ((count(*) FILTER (l_quantity <> 0)
           - 1) * sum(l_quantity) / count(*) FILTER (l_quantity <> 0))), 6) AS weighted_std,
         count(*) FILTER (l_quantity <> 0) AS n_weights
       FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag, mean""",
)
def _weighted_stats(spark, folder):
    out = profile.weighted_stats(
        table(spark, folder, "lineitem"), "l_discount", "l_quantity", by=["l_returnflag"]
    )
    return rounded(out, 6, "weighted_mean", "weighted_std")


_WORDS = ", ".join(
    f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR AS word{i}" for i in range(4)
)


@query(
    "frame_digest",
    f"""SELECT count(*) AS n_rows, {_WORDS} FROM (
          SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS h
          FROM orders)""",
)
def _frame_digest(spark, folder):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return profile.frame_digest(table(spark, folder, "orders"), columns)


@query(
    "stage_counters",
    """SELECT event_type, count(DISTINCT user_id) AS n_files, sum(event_id % 10)::BIGINT AS total
       FROM events GROUP BY event_type""",
)
def _stage_counters(spark, folder):
    events = table(spark, folder, "events").withColumn("n", F.col("event_id") % 10)
    return profile.stage_counters(events, "user_id", "event_type", "n")


@query(
    "efficiency_by_bin",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) AS total,
         count(*) FILTER (o_orderstatus = 'F') / count(*) AS efficiency
       FROM orders GROUP BY o_orderpriority""",
)
def _efficiency(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("long").alias("passed"),
        F.lit(1).cast("long").alias("total"),
    )
    return profile.efficiency(orders, ["o_orderpriority"], "passed", "total")


RUNS = """runs AS (SELECT user_id % 5 AS fold, event_type AS init, avg(value) AS metric,
             max(value) AS peak FROM events GROUP BY 1, 2)"""


def runs(spark, folder):
    """Run table: users fall into folds, event types are the starts, mean value is the metric."""
    return (
        table(spark, folder, "events")
        .groupBy((F.col("user_id") % 5).alias("fold"), F.col("event_type").alias("init"))
        .agg(F.avg("value").alias("metric"), F.max("value").alias("peak"))
    )


@query(
    "describe_folds",
    f"""WITH {RUNS},
    d AS (SELECT fold, avg(metric) AS "metric.mean", stddev_samp(metric) AS "metric.std",
            min(metric) AS "metric.min", max(metric) AS "metric.max",
            quantile_cont(metric, 0.5) AS "metric.median", avg(peak) AS "peak.mean",
            stddev_samp(peak) AS "peak.std", min(peak) AS "peak.min", max(peak) AS "peak.max",
            quantile_cont(peak, 0.5) AS "peak.median" FROM runs GROUP BY fold)
    SELECT fold, metric, round(value, 5) AS value FROM
      (UNPIVOT d ON COLUMNS(* EXCLUDE fold) INTO NAME metric VALUE value)""",
)
def _describe_folds(spark, folder):
    out = compare.describe_folds(runs(spark, folder), "fold", ["metric", "peak"])
    return rounded(out, 5, "value")


@query(
    "group_mean_std",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean,
         round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1, 2""",
)
def _group_mean_std(spark, folder):
    out = compare.group_mean_std(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"
    )
    return rounded(out, 6, "mean", "std")


@query(
    "best_init_stats",
    f"""WITH {RUNS}, b AS (SELECT fold, max(metric) AS metric FROM runs GROUP BY fold)
    SELECT count(*) AS n_folds, round(avg(metric), 5) AS mean, round(stddev_samp(metric), 5) AS std,
      round(avg(metric) - 3 * stddev_samp(metric), 5) AS low,
      round(avg(metric) + 3 * stddev_samp(metric), 5) AS high FROM b""",
)
def _best_init_stats(spark, folder):
    out = compare.best_init_stats(runs(spark, folder), "fold", "metric", ["init"])
    return rounded(out, 5, "mean", "std", "low", "high")


@query(
    "fold_quartiles",
    """SELECT event_type, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
         round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
         max(value) AS max, max(value) AS best FROM events GROUP BY event_type""",
)
def _fold_quartiles(spark, folder):
    out = compare.fold_quartiles(table(spark, folder, "events"), "event_type", "value")
    return rounded(out, 6, "q1", "median", "q3")


@query(
    "best_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def _best_per_group(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return compare.best_per_group(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query(
    "first_of_group",
    """SELECT l_suppkey, l_shipmode_rank AS linenumber, l_extendedprice FROM (
         SELECT l_suppkey, l_linenumber AS l_shipmode_rank, l_extendedprice, row_number() OVER
           (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_linenumber) AS r FROM lineitem)
       WHERE r = 1""",
)
def _first_of_group(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", F.col("l_linenumber").alias("linenumber"), "l_extendedprice"
    )
    return compare.best_per_group(
        lines, ["l_suppkey"], "l_extendedprice", ["linenumber"], mode="min"
    )


@query(
    "metric_diff",
    """WITH d AS (SELECT CAST(epoch(ts) AS BIGINT) // 86400 AS day, round(avg(value), 4) AS metric
                  FROM events GROUP BY 1)
       SELECT day, metric, coalesce(round(metric - lag(metric) OVER (ORDER BY day), 4),
         'inf'::DOUBLE) AS metric_diff FROM d""",
)
def _metric_diff(spark, folder):
    day = F.floor(F.unix_timestamp("ts") / 86400).alias("day")
    daily = table(spark, folder, "events").groupBy(day).agg(
        F.round(F.avg("value"), 4).alias("metric")
    )
    return rounded(compare.metric_diff(daily, "day", ["metric"]), 4, "metric_diff")


@query(
    "cumulative_cutoff",
    """WITH r AS (SELECT c_nationkey, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS revenue
                  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
       s AS (SELECT *, revenue / sum(revenue) OVER () AS ratio FROM r),
       c AS (SELECT *, sum(ratio) OVER (ORDER BY revenue DESC, c_nationkey) AS cumulative FROM s)
       SELECT c_nationkey, revenue, round(ratio, 6) AS ratio, round(cumulative, 6) AS cumulative,
         cumulative - ratio <= 0.8 AS kept FROM c""",
)
def _cumulative_cutoff(spark, folder):
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    revenue = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    )
    out = compare.cumulative_cutoff(revenue, [F.desc("revenue"), "c_nationkey"], "revenue", 0.8)
    return rounded(out, 6, "ratio", "cumulative")


@query(
    "trapezoid_area",
    """WITH p AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
       SELECT l_returnflag, round(sum(a), 6) AS area FROM (
         SELECT l_returnflag, (y + lag(y) OVER w) / 2 * (l_linenumber - lag(l_linenumber) OVER w) AS a
         FROM p WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_linenumber)) GROUP BY 1""",
)
def _trapezoid(spark, folder):
    points = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.avg("l_quantity").alias("y")
    )
    out = trapezoid_area(points, "l_linenumber", "y", ["l_returnflag"], "area")
    return rounded(out, 6, "area")


WILCOXON_SQL = """
WITH RECURSIVE d AS (SELECT {diff} AS d FROM {source}),
c AS (SELECT abs(d) AS size, count(*) FILTER (d > 0) AS p, count(*) FILTER (d < 0) AS m,
        count(*) AS c FROM d WHERE d <> 0 GROUP BY 1),
r AS (SELECT *, sum(c) OVER (ORDER BY size) - c + (c + 1) / 2 AS rank FROM c),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, coalesce(sum(rank * p), 0)::DOUBLE AS w_plus,
        coalesce(sum(rank * m), 0)::DOUBLE AS w_minus,
        sum(c::DOUBLE * c * c - c) AS ties, (SELECT count(*) FROM d WHERE d = 0) AS zeros FROM r),
t AS (SELECT *, least(w_plus, w_minus) AS statistic, (least(w_plus, w_minus) - n * (n + 1.0) / 4)
    / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s),
signs AS (
    SELECT 0 AS k, 0 AS total, 1::DOUBLE AS ways WHERE (SELECT n <= 50 AND ties = 0 AND zeros = 0 FROM s)
    UNION ALL
    SELECT k + 1, total + CASE WHEN plus THEN k + 1 ELSE 0 END, sum(ways)
    FROM (SELECT DISTINCT k, total, ways FROM signs WHERE k < (SELECT n FROM s)), (VALUES (true), (false)) b(plus)
    GROUP BY 1, 2),
p AS (
    SELECT *, abs(z) / sqrt(2.0) AS x, (SELECT 2 * sum(ways) / pow(2.0, n) FROM signs WHERE k = n AND total <= statistic)
      AS exact FROM t)
SELECT n, w_plus, w_minus, statistic, round(z, 6) AS z,
  round(CASE WHEN n <= 50 AND ties = 0 AND zeros = 0 THEN least(1, exact) WHEN x > 7 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi())
    * exp(-x * x) * list_sum(list_transform(range(0, 300), lambda i: exp(2 * i * ln(2.0) + (2 * i + 1) * ln(greatest(x, 1e-300))
      + lgamma(i + 1.0) - lgamma(2.0 * i + 2))))) END, 6) + 0.0::DOUBLE AS p_value
FROM p
"""


@query(
    "wilcoxon",
    WILCOXON_SQL.format(
        diff="CAST(o_totalprice >= 250000 AS INTEGER) - CAST(n >= 4 AS INTEGER)",
        source="orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"
        " ON l_orderkey = o_orderkey",
    ),
)
def _wilcoxon(spark, folder):
    left, right = prediction_pair(spark, folder)
    pairs = left.join(right.withColumnRenamed("predicted_label", "other"), "o_orderkey")
    return rounded(compare.wilcoxon(pairs, "predicted_label", "other"), 6, "z", "p_value")


@query(
    "wilcoxon_values",
    WILCOXON_SQL.format(diff="l_partkey - 20 * l_suppkey", source="lineitem"),
)
def _wilcoxon_values(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("other", F.col("l_suppkey") * 20)
    return rounded(compare.wilcoxon(lines, "l_partkey", "other"), 6, "z", "p_value")


@query(
    "wilcoxon_daily",
    WILCOXON_SQL.format(
        diff="a - b",
        source="(SELECT CAST(epoch(ts) AS BIGINT) // 86400 AS day, sum(round(value * 100)::BIGINT) FILTER (event_type = 'click')"
        " AS a, sum(round(value * 100)::BIGINT) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)",
    ),
)
def _wilcoxon_daily(spark, folder):
    """Daily totals of two kinds of events, few enough days for the exact distribution."""
    day = F.floor(F.unix_timestamp("ts") / 86400).alias("day")
    cents = F.round(F.col("value") * 100).cast("long")
    of = {kind: F.sum(F.when(F.col("event_type") == kind, cents)) for kind in ("click", "view")}
    daily = table(spark, folder, "events").groupBy(day).agg(*[total.alias(kind) for kind, total in of.items()])
    return rounded(compare.wilcoxon(daily, "click", "view"), 6, "z", "p_value")


@query(
    "training_history",
    """SELECT CAST(epoch(ts) AS BIGINT) // 86400 AS day,
         round(avg(value) FILTER (event_type = 'click'), 5) AS click,
         round(avg(value) FILTER (event_type = 'error'), 5) AS error,
         round(avg(value) FILTER (event_type = 'purchase'), 5) AS purchase,
         round(avg(value) FILTER (event_type = 'signup'), 5) AS signup,
         round(avg(value) FILTER (event_type = 'view'), 5) AS view,
         round(avg(value) FILTER (event_type = 'view') - avg(value) FILTER (event_type = 'click'), 5)
           AS gap
       FROM events GROUP BY 1""",
)
def _training_history(spark, folder):
    events = table(spark, folder, "events").withColumn(
        "day", F.floor(F.unix_timestamp("ts") / 86400)
    )
    kinds = sorted(r[0] for r in collect_bounded(events.select("event_type").distinct(), 100, "kinds"))
    out = compare.training_history(events, "day", "event_type", "value", kinds)
    return rounded(compare.with_gap(out, "click", "view"), 5, *kinds, "gap")


@query(
    "best_epoch",
    """SELECT event_type, day, round(metric, 5) AS metric FROM (
         SELECT event_type, CAST(epoch(ts) AS BIGINT) // 86400 AS day, avg(value) AS metric
         FROM events GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY metric DESC, day) = 1""",
)
def _best_epoch(spark, folder):
    day = F.floor(F.unix_timestamp("ts") / 86400).alias("day")
    daily = table(spark, folder, "events").groupBy("event_type", day).agg(
        F.avg("value").alias("metric")
    )
    return rounded(compare.best_per_group(daily, ["event_type"], "metric", ["day"]), 5, "metric")


@query(
    "best_worst",
    """(SELECT o_orderkey, o_totalprice, 'best' AS place FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
       UNION ALL (SELECT o_orderkey, o_totalprice, 'worst' FROM orders
        ORDER BY o_totalprice, o_orderkey LIMIT 1)""",
)
def _best_worst(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return compare.best_and_worst(orders, "o_totalprice", ["o_orderkey"])


@query(
    "sample_head",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 10""",
)
def _sample_head(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return compare.sample_head(table(spark, folder, "lineitem").select(*keys), keys, 10)


@query(
    "select_best_run",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1",
)
def _select_best_run(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return compare.best_run(customers, "c_acctbal", ["c_custkey"], mode="min")


@query(
    "pick_child",
    f"""WITH {RUNS}, best AS (SELECT fold, init FROM runs ORDER BY metric DESC, fold, init LIMIT 1)
    SELECT count(*) AS n, round(sum(value), 2) AS total FROM events
    JOIN best ON user_id % 5 = fold AND event_type = init""",
)
def _pick_child(spark, folder):
    """Rows that belong to the best run."""
    best = compare.best_run(runs(spark, folder), "metric", ["fold", "init"])
    keys = best.select("fold", F.col("init").alias("event_type"))
    events = table(spark, folder, "events").withColumn("fold", F.col("user_id") % 5)
    picked = events.join(keys, ["fold", "event_type"], "left_semi")
    return picked.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
