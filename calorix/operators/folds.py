"""Cross-validation columns and splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calorix.operators.ordering import with_group_rank, with_position
from calorix.session import collect_bounded

MAX_FOLDS = 127  # the fold column is a byte


def stratified_kfold(
    df: DataFrame,
    n_folds: int,
    id_col: str = "id",
    label_col: str = "label",
    fold_col: str = "fold",
    shuffle: bool = True,
    seed: int = 0,
    filter_cond: str | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Add a fold column in which every class, and the total, is spread evenly.

    Sorting by class and then by a seeded hash of the id and dealing positions out in turn
    makes the folds of a class differ by at most one row. The sort is a range partitioning, so
    a class that holds most rows is no hot spot. Rows that fail the filter keep a NULL fold.
    """
    if not 2 <= n_folds <= MAX_FOLDS:
        raise ValueError(f"n_folds must be between 2 and {MAX_FOLDS}")
    if fold_col in df.columns:
        if not overwrite:
            raise ValueError(f"column {fold_col} exists; pass overwrite=True to replace it")
        df = df.drop(fold_col)
    columns = df.columns
    eligible = df.where(F.expr(filter_cond)) if filter_cond else df
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    order = [label_col, "_key", id_col] if shuffle else [label_col, id_col]
    placed = with_position(eligible.withColumn("_key", key), order, "_position")
    fold = (F.col("_position") % n_folds).cast("byte").alias(fold_col)
    dealt = placed.select(*columns, fold)
    if not filter_cond:
        return dealt
    rest = df.where(~F.coalesce(F.expr(filter_cond), F.lit(False)))
    return dealt.unionByName(rest.withColumn(fold_col, F.lit(None).cast("byte")))


def train_rows(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """Rows of every study fold but one (NULL and negative folds are outside the study)."""
    return df.where((F.col(fold_col) != fold) & (F.col(fold_col) >= 0))


def validation_rows(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    return df.where((F.col(fold_col) == fold) & (F.col(fold_col) >= 0))


def study_rows(df: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Training and validation rows together, in one filter."""
    return df.where(F.col(fold_col) >= 0)


def fold_values(df: DataFrame, fold_col: str = "fold") -> list[int]:
    rows = collect_bounded(df.select(fold_col).distinct(), 256, "fold values")
    return sorted(r[0] for r in rows if r[0] is not None)


def all_splits(df: DataFrame, fold_col: str = "fold", folds: Sequence[int] | None = None):
    """Every row once per fold, tagged as validation or training row of that split.

    The copies come from a literal array of the fold numbers, so no join is involved.
    """
    values = list(folds) if folds is not None else fold_values(df, fold_col)
    split = F.explode(F.array(*[F.lit(int(v)) for v in values])).alias("split")
    return df.select("*", split).withColumn("is_val", F.col(fold_col) == F.col("split"))


def iterate_splits(
    df: DataFrame, fold_col: str = "fold"
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, training frame, validation frame) for every fold; no restriction to fold >= 0."""
    for fold in fold_values(df, fold_col):
        yield fold, df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def head_fraction(
    df: DataFrame, group: Sequence[str], order: Sequence[str], fraction: float
) -> DataFrame:
    """The first ``floor(n * fraction)`` rows of every group."""
    ranked = with_group_rank(df, group, order, "_rank", "_size")
    keep = F.col("_rank") <= F.floor(F.col("_size") * F.lit(float(fraction)))
    return ranked.where(keep).drop("_rank", "_size")


def class_weights(
    df: DataFrame, label_col: str = "label", filter_cond: str | None = None
) -> DataFrame:
    """Balanced weights ``n / (classes * count)``; rows without a label do not count."""
    rows = df.where(F.expr(filter_cond)) if filter_cond else df
    counts = rows.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count("*").alias("n_samples")
    )
    every = Window.partitionBy()  # one row per class
    weight = F.sum("n_samples").over(every) / (F.count("*").over(every) * F.col("n_samples"))
    return counts.select(F.col(label_col).alias("label"), "n_samples", weight.alias("weight"))


def class_weight_map(df: DataFrame, label_col: str = "label") -> dict:
    rows = collect_bounded(class_weights(df, label_col), 1000, "classes")
    return {r["label"]: r["weight"] for r in sorted(rows, key=lambda r: r["label"])}
