"""Legacy binned inputs: typed blocks, per-bin references, list-valued configuration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.operators.ordering import with_position


def glue_blocks(
    blocks: Sequence[DataFrame], key: Sequence[str], id_col: str | None = None, start: int = 0
) -> DataFrame:
    """Put typed column blocks side by side on their (file, row) key.

    Blocks are joined on the key and never on row order. Without an ``id_col`` among the
    columns, ids are numbered in key order from ``start``.
    """
    glued = reduce(lambda a, b: a.join(b, list(key), "inner"), blocks)
    if id_col is None or id_col in glued.columns:
        return glued
    return with_position(glued, list(key), id_col, start)


def explode_references(
    df: DataFrame,
    background: str = "bkgRef",
    signal: str = "sgnRef",
    et_bins: str = "etBins",
    eta_bins: str = "etaBins",
    et_index: str = "etBinIdx",
    eta_index: str = "etaBinIdx",
) -> DataFrame:
    """One row per (bin, class, identification name) from maps name → (total, passed, reference).

    Both classes come from one pass over the input; bin bounds are looked up by index.
    """

    def bound(edges: str, index: str, step: int) -> Column:
        return F.get(F.col(edges), F.col(index) + step).cast("float")

    tagged = F.array(
        F.struct(F.lit(0).alias("label"), F.col(background).alias("refs")),
        F.struct(F.lit(1).alias("label"), F.col(signal).alias("refs")),
    )
    per_class = df.select(
        bound(et_bins, et_index, 0).alias("et_bin_lower"),
        bound(et_bins, et_index, 1).alias("et_bin_upper"),
        bound(eta_bins, eta_index, 0).alias("eta_bin_lower"),
        bound(eta_bins, eta_index, 1).alias("eta_bin_upper"),
        F.inline(tagged),
    )
    bins = ["et_bin_lower", "et_bin_upper", "eta_bin_lower", "eta_bin_upper"]
    return per_class.select(*bins, "label", F.explode("refs").alias("pid", "ref")).select(
        *bins,
        "pid",
        "label",
        F.col("ref.total").cast("long").alias("total"),
        F.col("ref.passed").cast("long").alias("passed"),
        F.col("ref.reference").cast("string").alias("reference"),
    )


def conf_to_rows(
    df: DataFrame,
    columns: dict[str, str],
    keep: Sequence[str] = (),
    separator: str = "; ",
) -> DataFrame:
    """Turn parallel ``"; "``-separated lists into one row per list position.

    ``columns`` maps each list column to the type of its values. Lists of unequal length are an
    error, not a silent NULL.
    """
    lists = {c: F.split(F.col(c), F.lit(separator)) for c in columns}
    sizes = [F.size(parts) for parts in lists.values()]
    equal = reduce(lambda a, b: a & b, [sizes[0] == s for s in sizes[1:]], F.lit(True))
    zipped = F.arrays_zip(*[parts.alias(c) for c, parts in lists.items()])
    checked = F.when(equal, zipped).otherwise(F.raise_error(F.lit("list sizes differ")))
    rows = df.select(*keep, F.posexplode(checked).alias("position", "_item"))
    return rows.select(
        *keep,
        "position",
        *[F.col(f"_item.{c}").cast(t).alias(c) for c, t in columns.items()],
    )
