"""Comparing runs, folds and models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.functions.stats import EXACT_LIMIT, two_sided_normal, two_sided_rank_sum
from calorix.operators.ordering import with_running_totals
from calorix.session import few


def _direction(metric: str, mode: str) -> Column:
    if mode not in ("min", "max"):
        raise ValueError(f"mode is min or max, not {mode}")
    return F.asc_nulls_last(metric) if mode == "min" else F.desc_nulls_last(metric)


def best_per_group(
    df: DataFrame, group: Sequence[str], metric: str, tie: Sequence[str], mode: str = "max"
) -> DataFrame:
    """Row with the best metric of each group; ties go to the smallest tie key.

    The rank filter is pushed below the shuffle, so a task sends one row per group.
    """
    order = Window.partitionBy(*group).orderBy(_direction(metric, mode), *tie)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def best_run(df: DataFrame, metric: str, tie: Sequence[str], mode: str = "max") -> DataFrame:
    """The one row with the best metric."""
    return df.orderBy(_direction(metric, mode), *tie).limit(1)


def best_and_worst(df: DataFrame, metric: str, tie: Sequence[str], mode: str = "max") -> DataFrame:
    """Best and worst row by a metric, tagged with their place."""
    opposite = "max" if mode == "min" else "min"
    best = best_run(df, metric, tie, mode).withColumn("place", F.lit("best"))
    worst = best_run(df.where(F.col(metric).isNotNull()), metric, tie, opposite)
    return best.unionByName(worst.withColumn("place", F.lit("worst")))


def sample_head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in a stated order, so that the sample is repeatable."""
    return df.orderBy(*order).limit(n)


def describe_folds(df: DataFrame, fold: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample spread, minimum, maximum and median of each metric per fold, in long form.

    The input is a table of runs, a few per fold; for groups of any size take the quantiles from
    :func:`exact_quantiles`.
    """
    aggs, names = [], []
    for m in metrics:
        v = F.col(m).cast("double")
        for name, expr in (
            ("mean", F.avg(v)),
            ("std", F.stddev_samp(v)),
            ("min", F.min(v)),
            ("max", F.max(v)),
            ("median", F.percentile(v, 0.5)),
        ):
            names.append(f"{m}.{name}")
            aggs.append(expr.alias(names[-1]))
    wide = df.groupBy(fold).agg(*aggs)
    return wide.unpivot([fold], [F.col(f"`{n}`") for n in names], "metric", "value")


def group_mean_std(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    v = F.col(metric).cast("double")
    return df.groupBy(*group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")
    )


def best_init_stats(
    df: DataFrame, fold: str, metric: str, tie: Sequence[str], mode: str = "max"
) -> DataFrame:
    """Mean and spread across folds of each fold's best metric, with a three-sigma band."""
    best = best_per_group(df, [fold], metric, tie, mode)
    stats = best.agg(
        F.count("*").alias("n_folds"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
    )
    return stats.withColumns(
        {"low": F.col("mean") - 3 * F.col("std"), "high": F.col("mean") + 3 * F.col("std")}
    )


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group, for groups of any size.

    Values are counted first; the counts are summed in value order range by range, and each
    quantile is read off the two values that hold its neighbouring ranks. No group is gathered
    in one task.
    """
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*group, v.alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    summed = with_running_totals(counts, [*group, "_v"], {"_c": "_upto"})
    sizes = summed.groupBy(*group).agg(
        F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_before")
    )
    sizes = few(sizes, "group-sizes")
    same = [F.col(f"s.{g}").eqNullSafe(F.col(f"g.{g}")) for g in group]
    ranked = summed.alias("s").join(sizes.alias("g"), same).select(
        *[F.col(f"s.{g}") for g in group],
        "_v",
        "_n",
        (F.col("_upto") - F.col("_c") - F.col("_before")).alias("_first"),
        (F.col("_upto") - F.col("_before") - 1).alias("_last"),
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))

    aggs = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        aggs += [
            value_at(F.floor(at)).alias(f"_lo_{name}"),
            value_at(F.ceil(at)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_w_{name}"),
        ]
    found = ranked.groupBy(*group).agg(*aggs)
    return found.select(
        *group,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
            ).alias(n)
            for n in quantiles
        ],
    )


def fold_quartiles(df: DataFrame, fold: str, metric: str, mode: str = "max") -> DataFrame:
    """Box-plot numbers of a metric per fold and the best value."""
    points = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    out = exact_quantiles(df, [fold], metric, points)
    return out.withColumn("best", F.col("max" if mode == "max" else "min"))


def metric_diff(df: DataFrame, order: str, metrics: Sequence[str]) -> DataFrame:
    """Change of each metric from the previous row of a short ordered series.

    Meant for one row per searched value (a few dozen); the first change is infinite, so that
    it is never the smallest.
    """
    previous = Window.orderBy(order)
    return df.withColumns(
        {
            f"{m}_diff": F.coalesce(
                F.col(m) - F.lag(m).over(previous), F.lit(float("inf"))
            )
            for m in metrics
        }
    )


def cumulative_cutoff(
    df: DataFrame, order: Sequence[Column | str], value: str, limit: float = 0.99
) -> DataFrame:
    """Share and cumulative share of a short ordered series, and whether each item is kept.

    Items are kept up to and including the first whose cumulative share exceeds the limit.
    """
    whole = Window.partitionBy()
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col(value) / F.sum(value).over(whole)
    shared = df.withColumn("ratio", share).withColumn("cumulative", F.sum("ratio").over(upto))
    before = F.col("cumulative") - F.col("ratio")
    return shared.withColumn("kept", before <= limit)


def training_history(
    df: DataFrame, step: str, metric: str, value: str, names: Sequence[str]
) -> DataFrame:
    """One row per step and one column per metric from a long log."""
    return df.groupBy(step).pivot(metric, list(names)).agg(F.avg(value))


def with_gap(df: DataFrame, train: str, validation: str, name: str = "gap") -> DataFrame:
    return df.withColumn(name, F.col(validation) - F.col(train))


def run_records(
    df: DataFrame,
    run: Sequence[str],
    kind: str,
    key: str,
    value: str,
    names: dict[str, Sequence[str]],
) -> DataFrame:
    """One wide row per run with columns ``kind.key`` (``param.…``, ``metric.…``, ``tag.…``)."""
    columns = [f"{k}.{n}" for k, keys in names.items() for n in keys]
    tagged = df.withColumn("_name", F.concat_ws(".", F.col(kind), F.col(key)))
    return tagged.groupBy(*run).pivot("_name", columns).agg(F.max(value))


def signed_rank_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """Non-zero absolute differences with the number of positive and negative ones."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    return (
        df.select(d.alias("_d"))
        .where((F.col("_d") != 0) & ~F.isnan("_d"))
        .groupBy(F.abs("_d").alias("size"))
        .agg(F.count_if(F.col("_d") > 0).alias("n_pos"), F.count_if(F.col("_d") < 0).alias("n_neg"))
    )


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """Wilcoxon signed-rank test of paired values, as one row.

    Equal differences share the average of their ranks, found from cumulative counts of the
    distinct sizes; zero differences are dropped. ``z`` carries the tie correction. ``p_value`` is
    two-sided: from the exact distribution for at most 50 differences without ties and zeros, else
    from ``z``; NULL without differences.
    """
    d = F.col(x).cast("double") - F.col(y).cast("double")
    counts = df.select(d.alias("_d")).where(F.col("_d").isNotNull() & ~F.isnan("_d")).groupBy(
        F.abs("_d").alias("size")
    ).agg(
        F.count_if(F.col("_d") > 0).alias("n_pos"),
        F.count_if(F.col("_d") < 0).alias("n_neg"),
        F.count_if(F.col("_d") == 0).alias("n_zero"),
    )
    counts = counts.withColumn("_c", F.col("n_pos") + F.col("n_neg"))
    ranked = with_running_totals(counts, ["size"], {"_c": "_upto"})
    c = F.col("_c").cast("double")
    rank = F.col("_upto") - c + (c + 1) / 2
    sums = ranked.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(rank * F.col("n_pos")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(rank * F.col("n_neg")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(c * c * c - c), F.lit(0.0)).alias("_ties"),
        F.coalesce(F.sum("n_zero"), F.lit(0)).alias("_zeros"),
    )
    n = F.col("n").cast("double")
    statistic = F.least("w_plus", "w_minus")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24
    z = F.when(variance > 0, (statistic - n * (n + 1) / 4) / F.sqrt(variance))
    tested = sums.select("*", statistic.alias("statistic"), z.alias("z"))
    plain = (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    exact = two_sided_rank_sum(F.col("n"), F.col("statistic"))
    p_value = F.when(plain & (F.col("n") <= EXACT_LIMIT), exact).otherwise(two_sided_normal(F.col("z")))
    return tested.select("n", "w_plus", "w_minus", "statistic", "z", p_value.alias("p_value"))


def normal_p_value(z: float) -> float:
    """Two-sided p-value of a standard normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))
