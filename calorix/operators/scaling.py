"""Scaling parameters and their use."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.functions.physics import standard_score
from calorix.operators.folds import train_rows


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def scaling_params(
    df: DataFrame, columns: Sequence[str] | str, ddof: int = 0, absolute: Sequence[str] = ()
) -> DataFrame:
    """One row with ``avg_c`` and ``std_c`` of every column, in a single pass.

    ``ddof`` 0 is the population spread and 1 the sample spread. ``columns`` may be a name
    pattern; columns in ``absolute`` enter by their absolute value.
    """
    names = matching_columns(df, columns) if isinstance(columns, str) else list(columns)
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp

    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.abs(v) if c in absolute else v

    return df.agg(
        *[f(value(c)).alias(p + c) for c in names for f, p in ((F.avg, "avg_"), (spread, "std_"))]
    )


def fold_scaling_params(
    df: DataFrame,
    fold: int,
    columns: Sequence[str],
    absolute: Sequence[str] = (),
    fold_col: str = "fold",
) -> DataFrame:
    """Scaling parameters of a fold's training rows, with the sample spread."""
    return scaling_params(train_rows(df, fold, fold_col), columns, ddof=1, absolute=absolute)


def standard_scale(
    df: DataFrame, params: dict[str, float], columns: Sequence[str], absolute: Sequence[str] = ()
) -> DataFrame:
    """Replace columns by their standard score; ``params`` is one row of scaling parameters."""
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        v = F.abs(v) if c in absolute else v
        out[c] = standard_score(v, F.lit(params[f"avg_{c}"]), F.lit(params[f"std_{c}"]))
    return df.withColumns(out)
