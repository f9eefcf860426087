"""Writing frames, tables and registries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.operators.ordering import with_position


def write_gzip(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()):
    """Write gzip parquet, optionally in one folder per source or fold for later pruning."""
    writer = df.write.mode(mode).option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_frame(df: DataFrame, root: str, name: str) -> None:
    """Save a named frame in a dataset folder."""
    write_gzip(df, f"{root}/{name}", mode="overwrite")


def table_from_files(
    spark: SparkSession, patterns: Sequence[str], table: str, overwrite: bool = False
) -> DataFrame:
    """Create a table from the first file pattern and append the others **by position**."""
    for i, pattern in enumerate(patterns):
        part = spark.read.parquet(pattern)
        if i == 0 and (overwrite or not spark.catalog.tableExists(table)):
            part.write.mode("overwrite").saveAsTable(table)
        else:
            part.write.insertInto(table)
    return spark.table(table)


def append_by_position(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of a by-position append: names and types come from the first frame."""
    for other in others:
        if len(other.columns) != len(first.columns):
            raise ValueError("appended frames need the same number of columns")
    return reduce(DataFrame.union, others, first)


def append_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of a by-name append: a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def source_registry(
    spark: SparkSession, entries: Sequence[tuple[str, str | None, int]]
) -> DataFrame:
    """Registry of inputs: ``(name, description, label)`` numbered from 1."""
    rows = [(i, n, d, int(y)) for i, (n, d, y) in enumerate(entries, start=1)]
    return spark.createDataFrame(rows, "source_id long, name string, description string, label int")


def numbered_sources(names: DataFrame, label: Column) -> DataFrame:
    """Registry of the distinct ``name`` rows, numbered from 1 by name; ``label`` may use the
    number. Any number of sources: the registry stays a DataFrame."""
    numbered = with_position(names, ["name"], "source_id", 1)
    return numbered.select(
        F.col("source_id").cast("long").alias("source_id"),
        "name",
        F.lit(None).cast("string").alias("description"),
        label.alias("label"),
    )


def labelled_sources(df: DataFrame, name_col: str, registry: DataFrame) -> DataFrame:
    """Attach the registry's id and label; rows of an unregistered source keep NULLs.

    The registry has one row per input file, so the planner broadcasts it by its known size.
    """
    entry = registry.select("source_id", F.col("name").alias("_name"), "label")
    return df.join(entry, F.col(name_col) == F.col("_name"), "left").drop("_name")
