"""Registry of the runnable queries and the stand-in columns they share.

A query is a function ``(spark, folder) -> DataFrame`` over the driver's tables, registered with
the SQL that gives the same result. Physics quantities are derived from table columns with
integer arithmetic, so that every engine computes the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(build, sql)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def eta(c: str) -> Column:
    return ((F.col(c) * 37) % 5001) / F.lit(1000.0) - F.lit(2.5)


def phi(c: str) -> Column:
    return ((F.col(c) * 73) % 6284) / F.lit(1000.0) - F.lit(3.142)


def eta_sql(c: str) -> str:
    return f"((({c} * 37) % 5001) / 1000.0::DOUBLE - 2.5::DOUBLE)"


def phi_sql(c: str) -> str:
    return f"((({c} * 73) % 6284) / 1000.0::DOUBLE - 3.142::DOUBLE)"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
