"""The same helpers for SQL users: functions to register on a session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The functions' names and parameters, which users' SQL calls.
FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION standard_scaler(val DOUBLE, mean DOUBLE, std DOUBLE)
       RETURNS DOUBLE RETURN try_divide(val - mean, std)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION ringer_l1(val ARRAY<FLOAT>)
       RETURNS DOUBLE RETURN abs(aggregate(val, 0D, (s, x) -> s + x))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION ringer_norm(val ARRAY<FLOAT>)
       RETURNS DOUBLE RETURN coalesce(nullif(ringer_l1(val), 0D), 1D)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sp_index(tpr DOUBLE, fpr DOUBLE) RETURNS DOUBLE
       RETURN sqrt(sqrt(tpr * (1 - fpr)) * ((tpr + (1 - fpr)) / 2))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION delta_r(
         eta1 DOUBLE, phi1 DOUBLE, eta2 DOUBLE, phi2 DOUBLE) RETURNS DOUBLE
       RETURN sqrt(pow(eta1 - eta2, 2) + pow(
         CASE WHEN abs(phi1 - phi2) >= pi() THEN 2 * pi() - abs(phi1 - phi2)
              ELSE abs(phi1 - phi2) END, 2))""",
)


#: Mean and population spread of every numeric column whose name matches, one row per column.
SCALING_PARAMS = """SELECT key AS name, avg(x) AS mean, stddev_pop(x) AS std
  FROM (SELECT e.key, try_variant_get(e.value, '$', 'double') AS x
        FROM (SELECT to_variant_object(struct(*)) AS v FROM IDENTIFIER(:source)) t,
             LATERAL variant_explode(t.v) e
        WHERE e.key RLIKE :pattern)
  GROUP BY key"""


def register_functions(spark: SparkSession) -> None:
    """Create the temporary SQL functions and the statement ``scaling_params`` on this session.

    A function's table and result columns are fixed when it is made, so ``scaling_params`` is a
    variable that holds a statement; table and column pattern are its arguments::

        EXECUTE IMMEDIATE scaling_params USING 'lines' AS source, '^l_' AS pattern
    """
    for statement in FUNCTIONS:
        spark.sql(statement)
    spark.sql(f'DECLARE OR REPLACE VARIABLE scaling_params STRING DEFAULT "{SCALING_PARAMS}"')


def scaling_params(spark: SparkSession, source: str, pattern: str) -> DataFrame:
    """``avg_<c>, std_<c>`` (population) of the numeric columns of any table whose names match.

    The names are matched before the query is made, so only these columns are read.
    """
    fields = spark.table(source).schema.fields
    chosen = [
        f.name for f in fields if isinstance(f.dataType, NumericType) and re.search(pattern, f.name)
    ]
    if not chosen:
        raise ValueError(f"no numeric column of {source} matches {pattern!r}")
    return spark.table(source).agg(
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"avg_{c}") for c in chosen],
        *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"std_{c}") for c in chosen],
    )
