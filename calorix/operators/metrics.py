"""Classifier evaluation: threshold sweeps, ROC curves, areas, losses.

A sweep never compares every sample with every threshold. Each score is placed between two
thresholds, the placements are counted (two numbers per threshold and task), and the counts are
summed from the top over the small result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions.physics import sp_index
from calorix.operators.ordering import with_running_totals

SWEEP_POINTS = 300
TRAINING_POINTS = 100


def unit_thresholds(points: int = SWEEP_POINTS) -> list[float]:
    """Evenly spaced thresholds from 0 to 1."""
    return [i / (points - 1) for i in range(points)]


def _reached(df: DataFrame, score: str, thresholds: Sequence[float], inclusive: bool) -> DataFrame:
    """Add ``_at``: the number of thresholds the score reaches (``>=``) or exceeds (``>``)."""
    t = sorted(float(x) for x in thresholds)
    if len(set(t)) != len(t):
        raise ValueError("thresholds must be distinct")
    inf = float("inf")
    if inclusive:
        splits, value, at = [-inf, *t, inf], F.col(score), F.col("_bin")
    else:  # s > t is -s < -t, which the closed-left bins count from the other end
        splits = [-inf, *[-x for x in reversed(t)], inf]
        value, at = -F.col(score), F.lit(len(t)) - F.col("_bin")
    rows = df.withColumn("_s", value.cast("double")).where(
        F.col("_s").isNotNull() & ~F.isnan("_s")
    )
    placed = Bucketizer(splits=splits, inputCol="_s", outputCol="_bin").transform(rows)
    return placed.withColumn("_at", at.cast("int")).drop("_s", "_bin")


def sweep_counts(
    df: DataFrame,
    y: str,
    score: str,
    thresholds: Sequence[float],
    inclusive: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Positives and negatives per number of thresholds reached; mergeable by addition."""
    return (
        _reached(df.select(*by, y, score), score, thresholds, inclusive)
        .groupBy(*by, "_at")
        .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    )


def curve_from_counts(
    counts: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Turn sweep counts into one row per threshold with counts, rates, accuracy and SP."""
    t = sorted(float(x) for x in thresholds)
    zero = F.lit(0).cast("long")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(t)))).alias("_at")
    grid = (
        counts.select(*by).distinct().select(*by, every)
        if by
        else counts.sparkSession.range(1).select(every)
    )
    filled = (
        counts.unionByName(grid.withColumns({"_pos": zero, "_neg": zero}))
        .groupBy(*by, "_at")
        .agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    # at most len(thresholds) + 1 rows per group
    whole = Window.partitionBy(*by)
    above = whole.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    rows = filled.select(
        *by,
        "_at",
        F.sum("_pos").over(above).alias("tp"),
        F.sum("_neg").over(above).alias("fp"),
        F.sum("_pos").over(whole).alias("_p"),
        F.sum("_neg").over(whole).alias("_n"),
    ).where(F.col("_at") > 0)
    values = F.array(*[F.lit(x) for x in t])
    return with_rates(
        rows.select(
            *by,
            F.get(values, F.col("_at") - 1).alias("threshold"),
            "tp",
            "fp",
            (F.col("_n") - F.col("fp")).alias("tn"),
            (F.col("_p") - F.col("tp")).alias("fn"),
        )
    )


def with_rates(df: DataFrame) -> DataFrame:
    """Add tpr, fpr, acc and sp to confusion counts; an empty class has NULL rates."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return df.withColumns(
        {
            "tpr": F.try_divide("tp", p),
            "fpr": F.try_divide("fp", n),
            "acc": F.try_divide(F.col("tp") + F.col("tn"), p + n),
        }
    ).withColumn("sp", sp_index("tpr", "fpr"))


def roc_curve(
    df: DataFrame,
    y: str,
    score: str,
    thresholds: Sequence[float] | None = None,
    inclusive: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and rates at every threshold, thresholds kept with their rows."""
    t = unit_thresholds() if thresholds is None else thresholds
    return curve_from_counts(sweep_counts(df, y, score, t, inclusive, by), t, by)


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds=None, by=()) -> DataFrame:
    """The sweep that counts a score as positive only **above** the threshold."""
    return roc_curve(df, y, score, thresholds, inclusive=False, by=by)


def exact_roc(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC with every distinct score as a threshold.

    Scores are counted first; the cumulative sums over what remains run range by range, so the
    number of distinct scores is not limited. The curve starts at (0, 0), listed with
    threshold 1.
    """
    counts = (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    )
    summed = with_running_totals(counts, [F.desc("threshold")], {"_pos": "tp", "_neg": "fp"})
    totals = counts.agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("n"),
    ).first()
    start = df.sparkSession.range(1).select(
        F.lit(1.0).alias("threshold"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"),
    )
    points = start.unionByName(summed.select("threshold", "tp", "fp"))
    return with_rates(
        points.select(
            "threshold",
            "tp",
            "fp",
            (F.lit(totals["n"]) - F.col("fp")).alias("tn"),
            (F.lit(totals["p"]) - F.col("tp")).alias("fn"),
        )
    )


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and negatives of every distinct score: ``threshold, _pos, _neg``. Counts of parts of
    the samples add up, and the exact curve, its area, the largest SP and the cross entropy all follow
    from them. Rows without a score are left out."""
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    )


def exact_max_sp(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the exact curve and its working point of the largest SP, as one row."""
    return max_sp_of_counts(score_counts(df, y, score))


def loss_of_counts(counts: DataFrame) -> DataFrame:
    """Rows, summed and mean binary cross entropy from :func:`score_counts`."""
    p = F.col("threshold")
    loss = F.col("_pos") * cross_entropy(F.lit(1.0), p) + F.col("_neg") * cross_entropy(F.lit(0.0), p)
    total = counts.agg(
        F.coalesce(F.sum(F.col("_pos") + F.col("_neg")), F.lit(0)).alias("n_samples"), F.sum(loss).alias("sum_loss")
    )
    return total.withColumn("mean_loss", F.try_divide("sum_loss", "n_samples"))


def max_sp_of_counts(counts: DataFrame) -> DataFrame:
    """Area and working point of the exact curve from :func:`score_counts`.

    The strip that a distinct score adds follows from its own counts and the totals up to it, so the
    area is a plain sum over the scores and no neighbour is looked up.
    """
    summed = with_running_totals(counts, [F.desc("threshold")], {"_pos": "tp", "_neg": "fp"})
    totals = counts.agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("n"),
    ).first()
    p, n = F.lit(totals["p"]), F.lit(totals["n"])
    tp, fp = F.col("tp"), F.col("fp")
    strip = F.try_divide((2 * tp - F.col("_pos")) * F.col("_neg"), 2.0 * p * n)
    known = {rate: F.coalesce(rate, F.lit(0.0)) for rate in ("tpr", "fpr")}
    points = with_rates(
        summed.select(
            "threshold",
            "tp",
            "fp",
            (n - fp).alias("tn"),
            (p - tp).alias("fn"),
            F.coalesce(strip, F.lit(0.0)).alias("_strip"),
        )
    )
    points = points.withColumns(known).withColumn("sp", sp_index("tpr", "fpr"))
    best = F.max(F.struct("sp", "threshold", "acc", "fpr", "tpr", "tp", "tn", "fp", "fn")).alias("b")
    names = ("acc", "sp", "fpr", "tpr", "tp", "tn", "fp", "fn", "threshold")
    out = {"sp": "max_sp", "threshold": "max_sp_thresh"}
    return points.agg(F.sum("_strip").alias("roc_auc"), best).select(
        *[F.col(f"b.{c}").alias(out.get(c, f"max_sp_{c}")) for c in names], "roc_auc"
    )


def trapezoid_area(
    curve: DataFrame, x: str = "fpr", y: str = "tpr", by: Sequence[str] = (), name: str = "auc"
) -> DataFrame:
    """Area under a curve of bounded size, taken in rising ``x`` (so it is not negative)."""
    order = Window.partitionBy(*by).orderBy(x, y)
    steps = curve.select(
        *by,
        ((F.col(y) + F.lag(y).over(order)) / 2 * (F.col(x) - F.lag(x).over(order))).alias("_a"),
    )
    return steps.groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(name))


def best_threshold(curve: DataFrame, by: Sequence[str] = (), highest: bool = True) -> DataFrame:
    """Row of the largest SP; among equals the highest (or lowest) threshold."""
    tie = F.desc("threshold") if highest else F.asc("threshold")
    best = Window.partitionBy(*by).orderBy(F.desc_nulls_last("sp"), tie)
    return curve.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def max_sp_metrics(
    df: DataFrame,
    y: str,
    score: str,
    points: int = TRAINING_POINTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Area under the curve and the working point of the largest SP, per group.

    Area and working point come from windows over the same curve, so the samples are read once.
    """
    thresholds = unit_thresholds(points)
    curve = roc_curve(df, y, score, thresholds, by=by)
    known = {rate: F.coalesce(rate, F.lit(0.0)) for rate in ("tpr", "fpr")}
    curve = curve.withColumns(known).withColumn("sp", sp_index("tpr", "fpr"))
    whole = Window.partitionBy(*by)
    rising = whole.orderBy("fpr", "tpr")
    strip = (F.col("tpr") + F.lag("tpr").over(rising)) / 2 * (
        F.col("fpr") - F.lag("fpr").over(rising)
    )
    best = whole.orderBy(F.desc("sp"), F.desc("threshold"))
    return (
        curve.withColumn("_strip", strip)
        .withColumn("roc_auc", F.coalesce(F.sum("_strip").over(whole), F.lit(0.0)))
        .withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .select(
            *by,
            F.col("acc").alias("max_sp_acc"),
            F.col("sp").alias("max_sp"),
            F.col("fpr").alias("max_sp_fpr"),
            F.col("tpr").alias("max_sp_tpr"),
            F.col("tp").alias("max_sp_tp"),
            F.col("tn").alias("max_sp_tn"),
            F.col("fp").alias("max_sp_fp"),
            F.col("fn").alias("max_sp_fn"),
            F.col("threshold").alias("max_sp_thresh"),
            "roc_auc",
        )
    )


def _log(p: Column) -> Column:
    """Natural logarithm bounded below, so that a certain miss costs a finite amount."""
    return F.when(p > 0, F.greatest(F.log(p), F.lit(-100.0))).otherwise(F.lit(-100.0))


def cross_entropy(y: Column, p: Column) -> Column:
    return -(y * _log(p) + (1 - y) * _log(1 - p))


def cross_entropy_from_logit(y: Column, x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def log_loss(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and summed binary cross entropy; the mean is over rows, not over batches."""
    loss = cross_entropy(F.col(y).cast("double"), F.col(p).cast("double"))
    return df.select(*by, loss.alias("_l")).groupBy(*by).agg(
        F.count("_l").alias("n_samples"),
        F.sum("_l").alias("sum_loss"),
        F.avg("_l").alias("mean_loss"),
    )


def weighted_log_loss(
    df: DataFrame, y: str, logit: str, weights: dict | None = None
) -> DataFrame:
    """Class-weighted cross entropy from logits, balanced unless weights are given.

    A weight depends on the class alone, so the losses are summed per class and the few sums
    are weighted afterwards; the samples are read once and never joined.
    """
    loss = cross_entropy_from_logit(F.col(y).cast("double"), F.col(logit).cast("double"))
    per_class = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("label")).agg(
        F.count("*").alias("n_samples"), F.sum(loss).alias("_loss")
    )
    if weights is None:
        every = Window.partitionBy()  # one row per class
        weight = F.sum("n_samples").over(every) / (F.count("*").over(every) * F.col("n_samples"))
    else:
        weight = F.lit(1.0)
        for label, w in weights.items():
            weight = F.when(F.col("label") == label, F.lit(float(w))).otherwise(weight)
    return per_class.withColumn("_w", weight).agg(
        F.sum("n_samples").alias("n_samples"),
        (F.sum(F.col("_w") * F.col("_loss")) / F.sum("n_samples")).alias("weighted_loss"),
    )


def accuracy(df: DataFrame, y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(y) == F.col(predicted)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg(hit).alias("accuracy"))


def test_record(df: DataFrame, y: str, score: str) -> DataFrame:
    """Loss and working point side by side, as one row."""
    record = max_sp_metrics(df, y, score).first()
    loss = log_loss(df, y, score).first()["mean_loss"]
    out = {"loss": loss, **record.asDict()}
    return df.sparkSession.createDataFrame([out])

