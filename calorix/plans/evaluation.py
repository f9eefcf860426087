"""Classifier evaluation and rule-based selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calorix.functions import physics as ph
from calorix.operators import metrics as me
from calorix.operators import selection as se
from calorix.operators.profile import histogram
from calorix.plans.base import eta, eta_sql, phi, phi_sql, query, rounded, table
from calorix.session import checkpoint_root
from calorix.sources.cutmaps import ETA_EDGES, builtin_cut_map

SCORE = "(l_quantity * 4 + l_linenumber) / 210"


def scored_lines(spark, folder):
    """Returned lines are the positives, the score grows with the quantity."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_quantity") * 4 + F.col("l_linenumber")) / 210).alias("score"),
        "l_linestatus",
        "l_orderkey",
    )


def _curve_sql(points: int, compare: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""s AS (SELECT {group}CAST(l_returnflag = 'R' AS INTEGER) AS y, {SCORE} AS score
                       FROM lineitem),
    u AS (SELECT {group}score, y, count(*) AS c FROM s GROUP BY ALL),
    t AS (SELECT i / {points - 1} AS threshold FROM range({points}) r(i)),
    k AS (SELECT {group}t.threshold,
            coalesce(sum(c) FILTER (y = 1 AND score {compare} threshold), 0)::BIGINT AS tp,
            coalesce(sum(c) FILTER (y = 0 AND score {compare} threshold), 0)::BIGINT AS fp,
            sum(c) FILTER (y = 1)::BIGINT AS p, sum(c) FILTER (y = 0)::BIGINT AS n
          FROM u, t GROUP BY {group}t.threshold),
    r AS (SELECT *, n - fp AS tn, p - tp AS fn, tp / p AS tpr, fp / n AS fpr,
            (tp + n - fp) / (p + n) AS acc FROM k),
    c AS (SELECT *, sqrt(sqrt(tpr * (1 - fpr)) * ((tpr + (1 - fpr)) / 2)) AS sp FROM r)"""


def _curve_columns(group: str = "") -> str:
    return (
        f"{group}round(threshold, 6) AS threshold, tp, fp, tn, fn, round(tpr, 6) AS tpr,"
        " round(fpr, 6) AS fpr, round(acc, 6) AS acc, round(sp, 6) AS sp"
    )


def _round_curve(df):
    return rounded(df, 6, "threshold", "tpr", "fpr", "acc", "sp")


@query("threshold_sweep", f"WITH {_curve_sql(300, '>')} SELECT {_curve_columns()} FROM c")
def _threshold_sweep(spark, folder):
    return _round_curve(me.threshold_sweep(scored_lines(spark, folder), "y", "score"))


@query("roc_curve", f"WITH {_curve_sql(300, '>=')} SELECT {_curve_columns()} FROM c")
def _roc_curve(spark, folder):
    return _round_curve(me.roc_curve(scored_lines(spark, folder), "y", "score"))


_AREA = """a AS (SELECT *, (tpr + lag(tpr) OVER w) / 2 * (fpr - lag(fpr) OVER w) AS strip
      FROM c WINDOW w AS ({part} ORDER BY fpr, tpr))"""


@query(
    "max_sp",
    f"""WITH {_curve_sql(100, ">=")}, {_AREA.format(part="")}
    SELECT round(acc, 6) AS max_sp_acc, round(sp, 6) AS max_sp, round(fpr, 6) AS max_sp_fpr,
      round(tpr, 6) AS max_sp_tpr, tp AS max_sp_tp, tn AS max_sp_tn, fp AS max_sp_fp,
      fn AS max_sp_fn, round(threshold, 6) AS max_sp_thresh,
      round((SELECT sum(strip) FROM a), 6) AS roc_auc
    FROM c ORDER BY sp DESC, threshold DESC LIMIT 1""",
)
def _max_sp(spark, folder):
    out = me.max_sp_metrics(scored_lines(spark, folder), "y", "score")
    return rounded(
        out, 6, "max_sp_acc", "max_sp", "max_sp_fpr", "max_sp_tpr", "max_sp_thresh", "roc_auc"
    )


@query(
    "roc_by_group",
    f"WITH {_curve_sql(300, '>=', 'l_linestatus')} SELECT {_curve_columns('l_linestatus, ')} FROM c",
)
def _roc_by_group(spark, folder):
    return _round_curve(
        me.roc_curve(scored_lines(spark, folder), "y", "score", by=["l_linestatus"])
    )


@query(
    "trapezoid_auc",
    f"""WITH {_curve_sql(300, ">=", "l_linestatus")}, {_AREA.format(part="PARTITION BY l_linestatus")}
    SELECT l_linestatus, round(sum(strip), 6) AS auc FROM a GROUP BY l_linestatus""",
)
def _trapezoid_auc(spark, folder):
    curve = me.roc_curve(scored_lines(spark, folder), "y", "score", by=["l_linestatus"])
    return rounded(me.trapezoid_area(curve, by=["l_linestatus"]), 6, "auc")


@query(
    "best_threshold",
    f"""WITH {_curve_sql(300, ">", "l_linestatus")}
    SELECT l_linestatus, round(threshold, 6) AS threshold, tp, fp, round(sp, 6) AS sp FROM c
    QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY sp DESC, threshold) = 1""",
)
def _best_threshold(spark, folder):
    curve = me.threshold_sweep(scored_lines(spark, folder), "y", "score", by=["l_linestatus"])
    best = me.best_threshold(curve, ["l_linestatus"], highest=False)
    return rounded(
        best.select("l_linestatus", "threshold", "tp", "fp", "sp"), 6, "threshold", "sp"
    )


@query(
    "exact_roc",
    f"""WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, {SCORE} AS threshold
                   FROM lineitem),
    g AS (SELECT threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
          FROM s GROUP BY 1),
    c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC)::BIGINT AS tp,
            sum(n) OVER (ORDER BY threshold DESC)::BIGINT AS fp, sum(p) OVER ()::BIGINT AS pp,
            sum(n) OVER ()::BIGINT AS nn FROM g
          UNION ALL SELECT 1, 0, 0, sum(p)::BIGINT, sum(n)::BIGINT FROM g)
    SELECT round(threshold, 6) AS threshold, tp, fp, nn - fp AS tn, pp - tp AS fn,
      round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr FROM c""",
)
def _exact_roc(spark, folder):
    curve = me.exact_roc(scored_lines(spark, folder), "y", "score").drop("acc", "sp")
    return rounded(curve, 6, "threshold", "tpr", "fpr")


EXACT_MAX_SP_SQL = f"""WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, {SCORE} AS threshold
                   FROM lineitem),
    g AS (SELECT threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
          FROM s GROUP BY 1),
    c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC)::BIGINT AS tp,
            sum(n) OVER (ORDER BY threshold DESC)::BIGINT AS fp, sum(p) OVER ()::BIGINT AS pp,
            sum(n) OVER ()::BIGINT AS nn FROM g
          UNION ALL SELECT 1, 0, 0, sum(p)::BIGINT, sum(n)::BIGINT FROM g),
    r AS (SELECT *, tp / pp AS tpr, fp / nn AS fpr FROM c),
    a AS (SELECT *, sqrt(sqrt(tpr * (1 - fpr)) * ((tpr + 1 - fpr) / 2)) AS sp,
            (tpr + lag(tpr) OVER w) / 2 * (fpr - lag(fpr) OVER w) AS strip
          FROM r WINDOW w AS (ORDER BY fpr, tpr))
    SELECT round((tp + nn - fp) / (pp + nn), 6) AS max_sp_acc, round(sp, 6) AS max_sp,
      round(fpr, 6) AS max_sp_fpr, round(tpr, 6) AS max_sp_tpr, tp AS max_sp_tp,
      nn - fp AS max_sp_tn, fp AS max_sp_fp, pp - tp AS max_sp_fn,
      round(threshold, 6) AS max_sp_thresh, (SELECT round(sum(strip), 6) FROM a) AS roc_auc
    FROM a QUALIFY row_number() OVER (ORDER BY sp DESC, threshold DESC) = 1"""
#: The same row with the cross entropy of all samples.
EXACT_POINT_SQL = f"""SELECT p.*, l.* FROM ({EXACT_MAX_SP_SQL}) p,
    (SELECT count(*) AS n_samples, round(sum(b), 6) AS sum_loss, round(avg(b), 6) AS mean_loss FROM (
      SELECT CASE WHEN l_returnflag = 'R' THEN -greatest(ln(greatest({SCORE}, 1e-300)), -100)
        ELSE -greatest(ln(greatest(1 - {SCORE}, 1e-300)), -100) END AS b FROM lineitem)) l"""


@query("exact_max_sp", EXACT_MAX_SP_SQL)
def _exact_max_sp(spark, folder):
    out = me.exact_max_sp(scored_lines(spark, folder), "y", "score")
    return rounded(
        out, 6, "max_sp_acc", "max_sp", "max_sp_fpr", "max_sp_tpr", "max_sp_thresh", "roc_auc"
    )


@query(
    "auc_lookup",
    f"""WITH {_curve_sql(300, ">=", "l_linestatus")}, {_AREA.format(part="PARTITION BY l_linestatus")},
    auc AS (SELECT l_linestatus, round(sum(strip), 6) AS auc FROM a GROUP BY 1)
    SELECT l_linestatus, l_linenumber, count(*) AS n, any_value(auc) AS auc
    FROM lineitem JOIN auc USING (l_linestatus) GROUP BY 1, 2""",
)
def _auc_lookup(spark, folder):
    """Area of each group next to another per-group aggregate."""
    curve = me.roc_curve(scored_lines(spark, folder), "y", "score", by=["l_linestatus"])
    auc = rounded(me.trapezoid_area(curve, by=["l_linestatus"]), 6, "auc")
    counts = table(spark, folder, "lineitem").groupBy("l_linestatus", "l_linenumber")
    return counts.agg(F.count("*").alias("n")).join(auc, "l_linestatus")


@query(
    "log_loss",
    f"""WITH s AS (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y, {SCORE} AS p
                   FROM lineitem)
    SELECT l_linestatus, count(*) AS n_samples, round(sum(-(y * ln(p) + (1 - y) * ln(1 - p))), 4)
      AS sum_loss, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS mean_loss
    FROM s GROUP BY 1""",
)
def _log_loss(spark, folder):
    out = me.log_loss(scored_lines(spark, folder), "y", "score", by=["l_linestatus"])
    return rounded(rounded(out, 4, "sum_loss"), 6, "mean_loss")


@query(
    "weighted_log_loss",
    f"""WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, ({SCORE} - 0.5) * 4 AS x
                   FROM lineitem),
    w AS (SELECT y, count(*) AS c FROM s GROUP BY y)
    SELECT count(*) AS n_samples, round(sum((SELECT sum(c) FROM w) / (2 * c)
      * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))) / count(*), 6) AS weighted_loss
    FROM s JOIN w USING (y)""",
)
def _weighted_log_loss(spark, folder):
    rows = scored_lines(spark, folder).withColumn("logit", (F.col("score") - 0.5) * 4)
    return rounded(me.weighted_log_loss(rows, "y", "logit"), 6, "weighted_loss")


@query(
    "given_weight_log_loss",
    f"""WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, ({SCORE} - 0.5) * 4 AS x
                   FROM lineitem)
    SELECT count(*) AS n_samples, round(sum(CASE y WHEN 1 THEN 2.5 ELSE 0.5 END
      * (greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))) / count(*), 6) AS weighted_loss FROM s""",
)
def _given_weight_log_loss(spark, folder):
    rows = scored_lines(spark, folder).withColumn("logit", (F.col("score") - 0.5) * 4)
    out = me.weighted_log_loss(rows, "y", "logit", {0: 0.5, 1: 2.5})
    return rounded(out, 6, "weighted_loss")


@query(
    "output_distribution",
    f"""SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_orderkey % 5 = 0 AS is_val,
      least(CAST(floor({SCORE} * 20) AS INTEGER), 19) AS bin, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def _output_distribution(spark, folder):
    """Score histogram of each class in the training and the validation part."""
    rows = scored_lines(spark, folder).withColumn("is_val", F.col("l_orderkey") % 5 == 0)
    edges = [i / 20 for i in range(21)]
    return histogram(rows, "score", edges=edges, by=["y", "is_val"]).select(
        "y", "is_val", "bin", "n"
    )


@query(
    "threshold_label",
    """SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS prediction,
         round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS proba,
         CASE WHEN 1 / (1 + exp(-embedding[1]::DOUBLE)) >= 0.5 THEN 1 ELSE 0 END AS predicted_label
       FROM embeddings""",
)
def _threshold_label(spark, folder):
    x = F.get("embedding", F.lit(0)).cast("double")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(x, 6).alias("prediction"),
        F.round(ph.sigmoid(x), 6).alias("proba"),
        ph.decide(ph.sigmoid(x), 0.5).alias("predicted_label"),
    )


@query(
    "accuracy",
    """SELECT label, count(*) AS n_samples,
         avg(CASE WHEN label % 2 = CAST(embedding[1] > 0 AS INTEGER) THEN 1 ELSE 0 END) AS accuracy
       FROM embeddings GROUP BY label""",
)
def _accuracy(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "label",
        (F.col("label") % 2).alias("y"),
        (F.get("embedding", F.lit(0)) > 0).cast("int").alias("guess"),
    )
    return me.accuracy(rows, "y", "guess", by=["label"])


# ---------------------------------------------------------------- rule-based selection

TRIGGER = se.TriggerColumns()
MODELS = ("loose", "medium", "tight")


def trigger_rows(spark, folder):
    """Lines as trigger objects: part number gives the direction, quantities the shapes."""
    lines = table(spark, folder, "lineitem")
    l2_eta, l2_phi = eta("l_partkey"), phi("l_partkey")
    energies = F.array(
        *[F.abs(F.col("l_quantity") - 3.0 * i) / F.lit(4.0) for i in range(24)]
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        (l2_eta + F.col("l_tax")).alias(TRIGGER.l1_eta),
        (l2_phi + F.col("l_discount")).alias(TRIGGER.l1_phi),
        l2_eta.alias(TRIGGER.eta),
        l2_phi.alias(TRIGGER.phi),
        F.col("l_quantity").alias(TRIGGER.et),
        (F.col("l_quantity") * (F.lit(0.6) + F.col("l_tax") * 4)).alias(TRIGGER.e237),
        (F.col("l_quantity") - F.col("l_discount")).alias(TRIGGER.e277),
        (F.col("l_linenumber") + F.lit(0.5)).alias(TRIGGER.emaxs1),
        (F.col("l_discount") * 40).alias(TRIGGER.e2tsts1),
        F.lit(0.01).alias(TRIGGER.weta2),
        F.lit(1.0).alias(TRIGGER.wstot),
        energies.alias(TRIGGER.energy_sample),
    )


_ENERGY = ", ".join(f"abs(l_quantity - {3.0 * i}::DOUBLE) / 4" for i in range(24))


def _map_values_sql(name: str) -> str:
    rows = builtin_cut_map(name).rows
    columns = ("et_min", "et_max", "eta_min", "eta_max", "had_et", "eratio", "rcore")
    body = ", ".join("(" + ", ".join(f"{r[c]!r}::DOUBLE" for c in columns) + ")" for r in rows)
    return f"(VALUES {body}) m({', '.join(columns)})"


def _cut_sql(name: str) -> str:
    """CASE chain of the selection for one map, over the same derived columns."""
    return f"""
    SELECT t.*, CASE
      WHEN abs(l1_eta) > 2.5 THEN 'invalid_l1_eta'
      WHEN abs(eta - l1_eta) > 0.1::DOUBLE THEN 'deta_too_big'
      WHEN CASE WHEN gap > pi() THEN 2 * pi() - gap ELSE gap END > 0.1::DOUBLE THEN 'dphi_too_big'
      WHEN abs(eta) > 2.47::DOUBLE OR m.rcore IS NULL THEN 'invalid_l2_eta'
      WHEN CASE WHEN e277 = 0 THEN -1 ELSE e237 / e277 END < m.rcore THEN 'rcore_too_small'
      WHEN NOT (abs(eta) > 2.37::DOUBLE OR (abs(eta) > 1.37::DOUBLE AND abs(eta) < 1.52::DOUBLE))
        AND NOT (f1 < 0.005::DOUBLE) AND
        CASE WHEN emaxs1 + e2tsts1 = 0 THEN -1 ELSE (emaxs1 - e2tsts1) / (emaxs1 + e2tsts1) END
          < m.eratio THEN 'eratio_too_small'
      WHEN et * 0.001::DOUBLE < 0 THEN 'et_too_small'
      WHEN (et - e277) / cosh(abs(eta)) > CASE WHEN et > 90000 THEN m.had_et ELSE 999 END
        THEN 'had_et_too_big'
      WHEN 0.01 > 99999 THEN 'weta2_too_big' WHEN 1.0 >= 99999 THEN 'wstot_too_big'
      WHEN f3 > 99999 THEN 'f3_too_big' ELSE '' END AS reason
    FROM t LEFT JOIN {_map_values_sql(name)} ON t.et >= m.et_min AND t.et < m.et_max
      AND abs(t.eta) >= m.eta_min AND abs(t.eta) < m.eta_max"""


_TRIGGER_SQL = f"""
x AS (SELECT *, {eta_sql("l_partkey")} AS eta, {phi_sql("l_partkey")} AS phi, [{_ENERGY}] AS es
      FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, eta, phi,
        eta + l_tax AS l1_eta, l_quantity AS et,
        abs(phi - CASE WHEN abs(phi + l_discount) > pi() THEN phi + l_discount - 2 * pi()
                  ELSE phi + l_discount END) AS gap,
        l_quantity * (0.6::DOUBLE + l_tax * 4) AS e237, l_quantity - l_discount AS e277,
        l_linenumber + 0.5::DOUBLE AS emaxs1, l_discount * 40 AS e2tsts1,
        CASE WHEN abs(list_sum(es)) > 1e-5 THEN (es[2] + es[6]) / list_sum(es) ELSE -1 END AS f1,
        (es[4] + es[8]) / (es[1] + es[5] + es[2] + es[6] + es[3] + es[7] + es[4] + es[8]) AS f3
      FROM x)"""


@query(
    "cut_select",
    f"""WITH {_TRIGGER_SQL}, c AS ({_cut_sql("loose")})
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      CAST(reason = '' AS INTEGER) AS loose_cutbased, reason AS loose_cutbased_reason FROM c""",
)
def _cut_select(spark, folder):
    return se.select_with_cuts(
        trigger_rows(spark, folder),
        {"loose": builtin_cut_map("loose")},
        return_reason=True,
        keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
    )


@query(
    "cut_reason_counts",
    f"WITH {_TRIGGER_SQL}, c AS ({_cut_sql('medium')}) SELECT reason, count(*) AS n FROM c GROUP BY 1",
)
def _cut_reason_counts(spark, folder):
    maps = {"medium": builtin_cut_map("medium")}
    rows = se.select_with_cuts(trigger_rows(spark, folder), maps, return_reason=True)
    return rows.groupBy(F.col("medium_cutbased_reason").alias("reason")).agg(
        F.count("*").alias("n")
    )


@query(
    "cut_multi",
    f"WITH {_TRIGGER_SQL}, "
    + ", ".join(f"c_{m} AS ({_cut_sql(m)})" for m in MODELS)
    + " SELECT l_linenumber, "
    + ", ".join(f"count(*) FILTER (model = '{m}' AND reason = '') AS {m}" for m in MODELS)
    + " FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS model, l_linenumber, reason FROM c_{m}" for m in MODELS)
    + ") GROUP BY 1",
)
def _cut_multi(spark, folder):
    maps = {m: builtin_cut_map(m) for m in MODELS}
    rows = se.select_with_cuts(trigger_rows(spark, folder), maps, keep=["l_linenumber"])
    return rows.groupBy("l_linenumber").agg(
        *[F.sum(f"{m}_cutbased").alias(m) for m in MODELS]
    )


@query(
    "cut_predictions",
    f"""WITH {_TRIGGER_SQL}, c AS ({_cut_sql("loose")})
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 1::BIGINT AS n_folders,
      CAST(reason = '' AS INTEGER) AS loose_cutbased FROM c""",
)
def _cut_predictions(spark, folder):
    """Trigger rows as files, classified file by file in one job, beside their input."""
    root = f"{checkpoint_root(spark)}/predict-{uuid.uuid4().hex}"
    trigger_rows(spark, folder).write.parquet(f"{root}/in")
    se.predict_files(
        spark, f"{root}/in", f"{root}/out", {"loose": builtin_cut_map("loose")}, concat=True
    )
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lineage = F.col("input_file").contains(root).cast("long").alias("n_folders")
    return spark.read.parquet(f"{root}/out").select(*keep, lineage, "loose_cutbased")


@query(
    "range_lookup",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, m.rcore, m.had_et
    FROM (SELECT *, abs({eta_sql("l_partkey")}) AS ae FROM lineitem) t
    LEFT JOIN {_map_values_sql("tight")} ON t.l_quantity >= m.et_min AND t.l_quantity < m.et_max
      AND t.ae >= m.eta_min AND t.ae < m.eta_max""",
)
def _range_lookup(spark, folder):
    tight = builtin_cut_map("tight")
    lines = table(spark, folder, "lineitem").withColumn(
        "cell", se.cell_index(tight, F.col("l_quantity"), F.abs(eta("l_partkey")))
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        se.threshold(tight, "rcore", F.col("cell")).alias("rcore"),
        se.threshold(tight, "had_et", F.col("cell")).alias("had_et"),
    )


@query(
    "shower_shapes",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v
                  FROM embeddings)
    SELECT vec_id, round((v[2] + v[6]) / list_sum(v), 6) AS f1,
      round((v[4] + v[8]) / list_sum(v[1:8]), 6) AS f3,
      round((v[1] - v[2]) / (v[1] + v[2]), 6) AS eratio, round(v[3] / v[4], 4) AS rcore FROM e""",
)
def _shower_shapes(spark, folder):
    v = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    rows = table(spark, folder, "embeddings").select("vec_id", v.alias("v"))
    at = [F.get("v", F.lit(i)) for i in range(4)]
    return rows.select(
        "vec_id",
        F.round(ph.first_layer_fraction("v"), 6).alias("f1"),
        F.round(ph.third_layer_fraction("v"), 6).alias("f3"),
        F.round(ph.peak_ratio(at[0], at[1]), 6).alias("eratio"),
        F.round(ph.core_ratio(at[2], at[3]), 4).alias("rcore"),
    )


MEMBERS = tuple(
    {
        "et_min": lo,
        "et_max": hi,
        "eta_min": a,
        "eta_max": b,
        "slope": 0.001 * (i + 1),
        "offset": 0.02 * j,
        "max_average_mu": 40.0,
    }
    for i, (lo, hi) in enumerate(((0.0, 20.0), (20.0, 40.0)))
    for j, (a, b) in enumerate(zip(ETA_EDGES, ETA_EDGES[1:]))
)


def _members_sql() -> str:
    columns = list(MEMBERS[0])
    names = [f"m_{c}" for c in columns]
    rows = ", ".join(
        "(" + ", ".join([str(i)] + [f"{m[c]!r}::DOUBLE" for c in columns]) + ")"
        for i, m in enumerate(MEMBERS)
    )
    return f"(VALUES {rows}) m(member, {', '.join(names)})"


@query(
    "binned_threshold",
    f"""SELECT coalesce(m.member, -1) AS member, count(*) AS n,
      count(*) FILTER (l_discount > m_slope * least(mu, m_max_average_mu) + m_offset) AS n_accepted
    FROM (SELECT *, abs({eta_sql("l_partkey")}) AS ae, (l_suppkey % 60)::DOUBLE AS mu
          FROM lineitem) t
    LEFT JOIN {_members_sql()} ON l_quantity >= m_et_min AND l_quantity < m_et_max
      AND ae >= m_eta_min AND ae < m_eta_max GROUP BY 1""",
)
def _binned_threshold(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_discount",
        "l_quantity",
        F.abs(eta("l_partkey")).alias("abs_eta"),
        (F.col("l_suppkey") % 60).cast("double").alias("mu"),
    )
    out = se.committee_decision(rows, MEMBERS, "l_discount", "l_quantity", "abs_eta", "mu")
    member = F.coalesce("member", F.lit(-1)).alias("member")
    return out.groupBy(member).agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted")
    )


COEF = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query(
    "linear_threshold",
    f"""WITH s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, {COEF}),
            lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) + 0.05 AS computed FROM embeddings)
    SELECT vec_id, round(computed, 6) AS computed, computed > 0.1 AS passed FROM s""",
)
def _linear_threshold(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id", ph.linear_score("embedding", COEF, 0.05).alias("computed")
    )
    return rounded(rows.withColumn("passed", F.col("computed") > 0.1), 6, "computed")
