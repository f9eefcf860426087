"""Threshold sweeps and losses against direct computation."""

import math

import pytest
from pyspark.sql import functions as F

from calorix.operators import metrics as me

DATA = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.0), (0, 1.0), (1, 0.75), (0, 0.25)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(DATA, "y int, s double")


@pytest.mark.parametrize("inclusive", [True, False])
def test_counts_at_every_threshold(scored, inclusive):
    thresholds = [0.0, 0.25, 0.5, 0.9, 1.0]
    curve = me.roc_curve(scored, "y", "s", thresholds, inclusive).collect()
    assert len(curve) == 5
    for r in curve:
        t = r["threshold"]
        over = [(y, s >= t if inclusive else s > t) for y, s in DATA]
        assert r["tp"] == sum(y == 1 and o for y, o in over)
        assert r["fp"] == sum(y == 0 and o for y, o in over)
        assert r["tp"] + r["fn"] == 4 and r["fp"] + r["tn"] == 4
        tpr, fpr = r["tp"] / 4, r["fp"] / 4
        assert r["sp"] == pytest.approx(
            math.sqrt(math.sqrt(tpr * (1 - fpr)) * (tpr + 1 - fpr) / 2)
        )
        assert r["acc"] == pytest.approx((r["tp"] + r["tn"]) / 8)


def test_missing_scores_do_not_count(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None), (1, float("nan"))], "y int, s double")
    for r in me.roc_curve(df, "y", "s", [0.0, 1.0]).collect():
        assert r["tp"] + r["fn"] == 1 and r["tpr"] is not None and r["fpr"] is None


def test_groups_keep_empty_thresholds(scored):
    grouped = scored.withColumn("g", F.col("s") > 0.6)
    curve = me.roc_curve(grouped, "y", "s", by=["g"])
    assert {r["g"]: r["count"] for r in curve.groupBy("g").count().collect()} == {
        True: 300,
        False: 300,
    }


def test_exact_curve_and_area(scored):
    curve = me.exact_roc(scored, "y", "s")
    assert curve.count() == len({s for _, s in DATA}) + 1
    ordered = curve.orderBy(F.desc("threshold"), "tp", "fp").collect()
    assert [r["tp"] for r in ordered] == [0, 0, 1, 2, 3, 3, 3, 4]
    pairs = [(a, b) for ya, a in DATA if ya == 1 for yb, b in DATA if yb == 0]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert me.trapezoid_area(curve).first()["auc"] == pytest.approx(expected)


def test_working_point_prefers_the_highest_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, s double")
    record = me.max_sp_metrics(df, "y", "s", points=11).first()
    assert record["max_sp"] == 1.0 and record["max_sp_thresh"] == pytest.approx(0.9)
    assert record["roc_auc"] == pytest.approx(1.0)
    curve = me.roc_curve(df, "y", "s", me.unit_thresholds(11))
    low = me.best_threshold(curve, highest=False).first()
    assert low["threshold"] == pytest.approx(0.2)


def test_losses(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4), (1, 0.0)], "y int, p double")
    out = me.log_loss(df, "y", "p").first()
    assert out["sum_loss"] == pytest.approx(-math.log(0.8) - math.log(0.6) + 100)
    assert out["mean_loss"] == pytest.approx(out["sum_loss"] / 3)


def test_weighted_loss(spark):
    data = [(1, 2.0), (0, -1.0), (0, 50.0), (0, 0.0)]
    df = spark.createDataFrame(data, "y int, x double")
    weight = {1: 4 / 2, 0: 4 / 6}
    losses = [weight[y] * (max(x, 0) - x * y + math.log1p(math.exp(-abs(x)))) for y, x in data]
    assert me.weighted_log_loss(df, "y", "x").first()["weighted_loss"] == pytest.approx(
        sum(losses) / 4
    )


def test_duplicate_thresholds_are_refused(scored):
    with pytest.raises(ValueError):
        me.roc_curve(scored, "y", "s", [0.5, 0.5])
