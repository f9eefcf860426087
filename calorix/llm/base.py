"""Registry of this folder's queries and the small things its operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\f\r"
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(build, sql)
        return build

    return register


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, unless their path has it already."""
    package = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _sent or str(package.parent) in known:
        return
    _sent.add(context.applicationId)
    held = Path(os.path.realpath(tempfile.mkdtemp())) / f"{package.name}.zip"
    with zipfile.ZipFile(held, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(held))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def shard_count(docs: DataFrame, text_col: str, shard_bytes: int) -> int:
    """Number of shards of about ``shard_bytes`` of text each: grows with the table."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.count("*")).first()
    return max(1, -(-((size[0] or 0) + 8 * size[1]) // shard_bytes))


def recurring(found: DataFrame, key: str, *sums: str) -> DataFrame:
    """``shard`` and ``key`` of the keys that are found twice or more in all shards together, with
    the ``sums`` over all shards.

    ``found`` has ``shard``, ``key`` and ``n``, the times one run of texts holds it in that shard, so
    a key that most rows hold has a row per run and shard here, not one per document.
    """
    everywhere = {c: F.sum(c).over(Window.partitionBy(key)) for c in ("n", *sums)}
    return found.withColumns(everywhere).where("n > 1").select("shard", key, *sums).distinct()


def similar_sql(words: int, num: int, den: int, extra: str = "") -> str:
    """Components of similar shingle sets: distinct sets, pairs that share a shingle, reachable sets."""
    lead = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
    shingled AS MATERIALIZED (
        SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {lead}))) END AS s
        FROM texts),
    nodes AS MATERIALIZED (
        SELECT row_number() OVER () AS k, s, len(s) AS n FROM (SELECT DISTINCT s FROM shingled WHERE len(s) > 0)),
    elements AS MATERIALIZED (SELECT k, n, unnest(s) AS e FROM nodes),
    links AS MATERIALIZED (
        SELECT a.k AS x, b.k AS y FROM elements a JOIN elements b ON a.e = b.e AND a.k < b.k
        WHERE {den} * a.n >= {num} * b.n AND {den} * b.n >= {num} * a.n
        GROUP BY a.k, b.k, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
    sides AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT k, k AS o FROM nodes UNION SELECT reach.k, sides.y FROM reach JOIN sides ON sides.x = reach.o),
    own AS (SELECT n.k, min(d.doc_id) AS least FROM nodes n JOIN shingled d ON d.s = n.s GROUP BY n.k),
    named AS (SELECT reach.k, min(own.least) AS c FROM reach JOIN own ON own.k = reach.o GROUP BY reach.k)
SELECT d.doc_id, len(d.s) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE named.c END AS component_id{extra}
FROM shingled d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN named ON named.k = n.k
"""
