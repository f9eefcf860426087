"""Training binary classifiers over folds and starts with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorix.functions.vectors import l1_normalise
from calorix.operators.folds import class_weight_map, fold_values, train_rows, validation_rows
from calorix.operators.metrics import log_loss, max_sp_metrics
from calorix.session import durable_model


def with_weights(df: DataFrame, label: str, weights: dict, out: str = "weight") -> DataFrame:
    value = F.lit(1.0)
    for y, w in weights.items():
        value = F.when(F.col(label) == y, F.lit(float(w))).otherwise(value)
    return df.withColumn(out, value)


def replicated(df: DataFrame, label: str, weights: dict) -> DataFrame:
    """Repeat rows by their rounded relative weight, for learners without sample weights.

    Every row is kept at least once.
    """
    least = min(weights.values())
    copies = F.lit(1)
    for y, w in weights.items():
        copies = F.when(F.col(label) == y, F.lit(max(1, round(w / least)))).otherwise(copies)
    return df.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).drop("_copy")


def _learner(kind: str, width: int, hidden: Sequence[int], max_iter: int, seed: int):
    if kind == "mlp":
        return MultilayerPerceptronClassifier(
            labelCol="_y", featuresCol="_x", layers=[width, *hidden, 2], maxIter=max_iter, seed=seed
        )
    if kind == "logistic":
        return LogisticRegression(
            labelCol="_y", featuresCol="_x", weightCol="weight", maxIter=max_iter
        )
    raise ValueError(f"unknown classifier: {kind}")


def train_folds(
    df: DataFrame,
    vector: str,
    label: str,
    fold_col: str = "fold",
    inits: int = 1,
    kind: str = "mlp",
    hidden: Sequence[int] = (8,),
    max_iter: int = 50,
    balanced: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Train every fold from several starts and report the validation metrics of each run.

    One row per (fold, init) with the loss and the working point of the largest SP on the
    fold's validation rows. Runs follow one another; each is a distributed fit over the cached
    rows.
    """
    rows = df.select(
        F.col(fold_col).alias("fold"),
        F.col(label).cast("double").alias("_y"),
        array_to_vector(l1_normalise(vector)).alias("_x"),
    ).persist()
    results = []
    try:
        width = df.select(F.size(vector)).first()[0]
        for fold in [f for f in fold_values(rows) if f >= 0]:
            train, val = train_rows(rows, fold), validation_rows(rows, fold)
            weights = class_weight_map(train, "_y") if balanced else {0.0: 1.0, 1.0: 1.0}
            if kind == "mlp":
                ready = replicated(train, "_y", weights)
            else:
                ready = with_weights(train, "_y", weights)
            for init in range(inits):
                model = _learner(kind, width, hidden, max_iter, seed + init).fit(ready)
                model = durable_model(df.sparkSession, model, f"model-{kind}")
                scored = model.transform(val).select(
                    F.col("_y").cast("int").alias("y"),
                    F.get(vector_to_array("probability"), F.lit(1)).alias("p"),
                )
                record = max_sp_metrics(scored, "y", "p").first().asDict()
                loss = log_loss(scored, "y", "p").first()["mean_loss"]
                results.append({"fold": int(fold), "init": init, "loss": loss, **record})
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(results)
