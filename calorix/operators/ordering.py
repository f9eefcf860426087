"""Global positions and running totals without a single-task window.

A window without a partition key, or keyed by one class that holds most rows, sorts everything
in one task. Here the rows are range-partitioned on the order key plus a salt, so that even a
long run of identical rows is spread over tasks; each range is numbered on its own and shifted
by the size of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorix.session import durable, few

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort on ``order``; ties fall to a row hash and then a salt.

    The salt only separates rows that agree on the order key and on every hashable column, so
    swapping two of them on a retry changes nothing.
    """
    keyed = df.withColumn("_tie", _tie(df)).withColumn("_salt", F.monotonically_increasing_id())
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie"), F.col("_salt")]
    return (
        keyed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie", "_salt")
        .withColumn("_slot", F.monotonically_increasing_id())
    )


def _before(per_range: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Totals of all earlier ranges; the input has one row per shuffle partition."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        "_range",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(out) for c, out in cols.items()],
    )


def _numbered(placed: DataFrame, columns: Sequence[str], out: str, start: int) -> DataFrame:
    """Dense numbers from the slots of a durable frame: offset of the range plus place in it."""
    in_range = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    numbered = placed.withColumn("_range", F.shiftright("_slot", _ROW_BITS))
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = _before(sizes, {"_n": "_offset"})
    # one row per partition of the written frame
    return numbered.join(F.broadcast(offsets), "_range").select(
        *columns, (in_range + F.col("_offset") + F.lit(start)).cast("long").alias(out)
    )


def with_position(
    df: DataFrame,
    order: Sequence[str | Column],
    position_col: str = "position",
    start: int = 0,
) -> DataFrame:
    """Add the dense global position of every row under ``order`` (``start``, ``start + 1``, …)."""
    return _numbered(durable(_ranged(df, order), "position"), df.columns, position_col, start)


def with_scan_index(df: DataFrame, index_col: str = "id", start: int = 1) -> DataFrame:
    """Number rows densely without a shuffle of the rows.

    The order is that of Spark's input splits: rows of a file stay in order, but files are packed
    into splits by size, so it is not the order of their names.
    """
    placed = durable(df.withColumn("_slot", F.monotonically_increasing_id()), "index")
    return _numbered(placed, df.columns, index_col, start)


#: Rows of a group beyond which its ranks are taken from global positions.
HOT_ROWS = 1_000_000


def _tie(df: DataFrame) -> Column:
    """A hash of the row that settles ties of an order key."""
    return F.xxhash64(
        *[f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    )


def with_group_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    rank_col: str = "rank",
    count_col: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 1-based rank inside ``group``, safe when one group holds most rows.

    A group of at most ``hot_rows`` rows is ranked by a window, after one exchange on the group.
    Larger groups, found by a count of the keys, are sorted globally by (group, order): a rank is
    then the distance from the group's first position, so such a group is cut into ranges like
    any other run of rows. Both ways order rows alike, so ranks do not hang on ``hot_rows``.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
    hot = few(sizes, "hot-groups")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group]
    if hot.isEmpty():
        return _window_rank(df, df, group, keys, rank_col, count_col)
    cold = df.alias("r").join(hot.alias("h"), same, "left_anti")
    placed = with_position(
        df.alias("r").join(hot.alias("h"), same, "left_semi"), [*group, *order], "_position"
    )
    starts = placed.groupBy(*group).agg(
        F.min("_position").alias("_first"), F.count("*").alias("_size")
    )
    # one row per hot group
    joined = placed.alias("r").join(few(starts, "group-starts").alias("h"), same)
    out = [F.col(f"r.{c}") for c in df.columns]
    out.append((F.col("_position") - F.col("_first") + 1).alias(rank_col))
    if count_col:
        out.append(F.col("_size").alias(count_col))
    return _window_rank(cold, df, group, keys, rank_col, count_col).unionByName(joined.select(*out))


def _window_rank(
    rows: DataFrame,
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[Column],
    rank_col: str,
    count_col: str | None,
) -> DataFrame:
    """Ranks (and sizes) of ``rows`` with the columns of ``df``, each group in one task."""
    in_group = Window.partitionBy(*group)
    out = [F.row_number().over(in_group.orderBy(*keys, "_tie")).cast("long").alias(rank_col)]
    if count_col:
        out.append(F.count("*").over(in_group).alias(count_col))
    return rows.withColumn("_tie", _tie(df)).select(*df.columns, *out)


def with_running_totals(
    df: DataFrame, order: Sequence[str | Column], totals: dict[str, str]
) -> DataFrame:
    """Add cumulative sums over the whole frame; ``totals`` maps a column to its total's name.

    ``order`` should be unique (group first); each range is summed by its own task.
    """
    ranged = _ranged(df, order).withColumn("_range", F.shiftright("_slot", _ROW_BITS))
    placed = durable(ranged, "running")
    per_range = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in totals])
    offsets = _before(per_range, {f"_t_{c}": f"_o_{c}" for c in totals})
    inside = (
        Window.partitionBy("_range")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return placed.join(F.broadcast(offsets), "_range").select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(out) for c, out in totals.items()],
    )
