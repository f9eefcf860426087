"""Scoring and training queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.operators import fitting
from calorix.operators.metrics import test_record
from calorix.operators.scaling import fold_scaling_params
from calorix.operators.scoring import Dense, score_mlp, score_two_branch
from calorix.operators.training import train_folds
from calorix.plans.base import eta, eta_sql, query, rounded, table
from calorix.plans.evaluation import _AREA, _curve_sql, scored_lines


def _weights(inputs: int, outputs: int, a: int, b: int) -> list[list[float]]:
    return [[((i * a + j * b) % 13 - 6) / 10 for j in range(outputs)] for i in range(inputs)]


HIDDEN = Dense(_weights(64, 4, 3, 5), [0.1, -0.1, 0.2, 0.0], "relu")
OUTPUT = Dense(_weights(4, 1, 2, 1), [0.05])
BRANCH = Dense(_weights(64, 3, 5, 7), [0.0, 0.1, 0.2], "relu")
TRUNK = Dense(_weights(3, 3, 2, 3), [0.5, 0.4, 0.3], "relu")

_NORMAL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e
                  FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN list_sum(e) = 0 THEN 1
        ELSE abs(list_sum(e)) END) AS x FROM v)"""


def _dot(vector: str, layer: Dense, j: int) -> str:
    column = [row[j] for row in layer.weights]
    return f"""(list_sum(list_transform(list_zip({vector}, {column}),
        lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) + {layer.bias[j]}::DOUBLE)"""


_DECISION = """round(p, 4) + 0.0::DOUBLE AS prediction, round(1 / (1 + exp(-p)), 4) AS proba,
    CASE WHEN 1 / (1 + exp(-p)) >= 0.5 THEN 1 ELSE 0 END AS predicted_label"""


@query(
    "score_mlp",
    f"""WITH {_NORMAL},
    h AS (SELECT vec_id, [{", ".join(f"greatest({_dot('x', HIDDEN, j)}, 0)" for j in range(4))}]
            AS h FROM n WHERE label < 8),
    o AS (SELECT vec_id, {_dot("h", OUTPUT, 0)} AS p FROM h)
    SELECT vec_id, {_DECISION} FROM o""",
)
def _score_mlp(spark, folder):
    out = score_mlp(
        table(spark, folder, "embeddings"), "vec_id", "embedding", [HIDDEN, OUTPUT], 0.5, "label < 8"
    )
    return rounded(out, 4, "prediction", "proba")


@query(
    "score_two_branch",
    f"""WITH {_NORMAL},
    q AS (SELECT n.*, vec_id::DOUBLE AS et, abs({eta_sql("vec_id")}) AS eta, label::DOUBLE AS mu
          FROM n),
    s AS (SELECT avg(et) AS me, stddev_samp(et) AS se, avg(eta) AS mh, stddev_samp(eta) AS sh,
            avg(mu) AS mm, stddev_samp(mu) AS sm FROM q WHERE vec_id % 5 <> 0),
    t AS (SELECT vec_id, x, [(et - me) / se, (eta - mh) / sh, (mu - mm) / sm] AS z FROM q, s),
    o AS (SELECT vec_id, {" + ".join(
        f"greatest({_dot('x', BRANCH, j)}, 0) * greatest({_dot('z', TRUNK, j)}, 0)"
        for j in range(3))} AS p FROM t)
    SELECT vec_id, {_DECISION} FROM o""",
)
def _score_two_branch(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        "embedding",
        F.col("vec_id").cast("double").alias("et"),
        eta("vec_id").alias("eta"),
        F.col("label").cast("double").alias("mu"),
        (F.col("vec_id") % 5).alias("fold"),
    )
    scaled = ["et", "eta", "mu"]
    params = fold_scaling_params(rows, 0, scaled, absolute=["eta"]).first().asDict()
    out = score_two_branch(
        rows, "vec_id", "embedding", scaled, params, [BRANCH], [TRUNK], 0.5, absolute=["eta"]
    )
    return rounded(out, 4, "prediction", "proba")


def _training_rows(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 3).alias("fold")
    )


@query("train_folds")
def _train_folds(spark, folder):
    return train_folds(
        _training_rows(spark, folder), "embedding", "y", kind="logistic", max_iter=10
    )


@query("train_folds_mlp")
def _train_folds_mlp(spark, folder):
    return train_folds(
        _training_rows(spark, folder), "embedding", "y", inits=2, kind="mlp", max_iter=10
    )


@query("train_early_stop")
def _train_early_stop(spark, folder):
    """Runs, stops and best epochs of two starts on each of three folds."""
    rows = _training_rows(spark, folder).withColumn("id", F.col("vec_id"))
    rules = fitting.TrainingRules(hidden=(8,), batches=2, max_epochs=6, patience=2, inits=2, rate=0.01)
    return fitting.training_report(spark, fitting.train_networks(rows, "embedding", "y", "id", rules=rules))


@query(
    "fold_costs",
    """WITH t AS (SELECT vec_id % 3 AS fold, count(*) FILTER (label < 5) AS n0, count(*) FILTER (label >= 5) AS n1
               FROM embeddings GROUP BY 1),
    o AS (SELECT a.fold, sum(b.n0) AS n0, sum(b.n1) AS n1 FROM t a JOIN t b ON a.fold <> b.fold GROUP BY 1)
    SELECT fold, round((n0 + n1) / (2 * n0), 6) AS weight_0, round((n0 + n1) / (2 * n1), 6) AS weight_1 FROM o""",
)
def _fold_costs(spark, folder):
    """Class weights of each fold's training rows."""
    costs = fitting.fold_costs(_training_rows(spark, folder), balanced=True)
    rows = [(fold, float(a), float(b)) for fold, (a, b) in costs.items()]
    return rounded(spark.createDataFrame(rows, "fold long, weight_0 double, weight_1 double"), 6, "weight_0", "weight_1")


@query(
    "test_record",
    f"""WITH {_curve_sql(100, ">=")}, {_AREA.format(part="")}
    SELECT (SELECT round(avg(-(y * ln(score) + (1 - y) * ln(1 - score))), 6) FROM s) AS loss,
      round(acc, 6) AS max_sp_acc, round(sp, 6) AS max_sp, round(fpr, 6) AS max_sp_fpr,
      round(tpr, 6) AS max_sp_tpr, tp AS max_sp_tp, tn AS max_sp_tn, fp AS max_sp_fp,
      fn AS max_sp_fn, round(threshold, 6) AS max_sp_thresh,
      round((SELECT sum(strip) FROM a), 6) AS roc_auc
    FROM c ORDER BY sp DESC, threshold DESC LIMIT 1""",
)
def _test_record(spark, folder):
    out = test_record(scored_lines(spark, folder), "y", "score")
    return rounded(out, 6, *[c for c, t in out.dtypes if t == "double"])
