"""URL rules looked up in cascades of Bloom filters.

A cascade holds a key list exactly over a known universe of keys. Level 1 is a Bloom filter of
the listed keys; level 2 holds the keys of the universe that level 1 lets through by mistake;
level 3 the listed keys that level 2 lets through, and so on until nothing is let through by
mistake. A key of the universe is listed if the first level that rejects it has an even number.
The universe here is every host suffix and path prefix of the corpus that has the shape
(labels, path length) of some rule, so judging a url is a handful of bit tests in its own row:
no join and no shuffle of pages. Only keys that pass level 1 are ever shuffled; their number is
about that of the listed keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.session import collect_bounded, durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` bits as 64-bit words, ``hashes`` seeds from ``seed`` on."""

    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def might_contain(self, key: Column) -> Column:
        # one literal; Spark folds the cast once per plan
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for place in _places(key, self.bits, self.hashes, self.seed):
            word = F.get(held, F.shiftright(place, 6).cast("int"))
            bit = F.call_function("shiftright", word, place.bitwiseAND(63).cast("int"))
            found = found & (bit.bitwiseAND(1) != 0)
        return found


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed + j)), F.lit(bits)) for j in range(hashes)]


def listed(key: Column, levels: Sequence[Level]) -> Column:
    """Whether a key of the universe is listed: the parity of the first rejecting level."""
    # a key that every level holds is of the class the last level encodes
    found = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        found = F.when(levels[number - 1].might_contain(key), found).otherwise(
            F.lit(number % 2 == 0)
        )
    return found


def _bloom(keys: DataFrame, n: int, rate: float, seed: int, max_words: int) -> Level:
    bits = max(64, math.ceil(n * 1.4427 * math.log2(1 / rate)))
    hashes = max(1, round(math.log2(1 / rate)))
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, hashes, seed))).alias("p"))
    set_bits = places.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("v")
    )
    held = [0] * (bits // 64 + 1)
    for w, v in collect_bounded(set_bits, max_words, "filter words"):
        held[w] = v
    return Level(bits, hashes, seed, tuple(held))


def build_cascade(
    listed_keys: DataFrame, universe: DataFrame, max_words: int = 1_000_000, max_levels: int = 64
) -> list[Level]:
    """Filters that hold ``listed_keys`` (column key) exactly over ``universe`` (column key).

    ``universe`` may repeat keys. ``max_words`` bounds the 64-bit words of one filter, about
    22 bits a listed key for a universe a million times larger; more raises an error.
    An empty list gives no level, and nothing is listed. Null keys are ignored.
    """
    wanted = listed_keys.where("key is not null").select("key").distinct()
    n = wanted.count()
    if not n:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, n * math.sqrt(0.5) / max(1, size))
    levels = [_bloom(wanted, n, rate, 1, max_words)]
    # what level 1 lets through, with its class; a listed key may be missing from the universe
    passed = universe.where(levels[0].might_contain(F.col("key"))).select("key", F.lit(0).alias("c"))
    both = wanted.select("key", F.lit(1).alias("c")).unionByName(passed)
    known = durable(both.groupBy("key").agg(F.max("c").alias("c")), "url-cascade")
    encoded = known.where("c = 0")
    while n := encoded.count():
        if len(levels) == max_levels:
            raise ValueError(f"no exact cascade within {max_levels} levels")
        # each level has its own seeds, so a key that slips through one is not bound to the next
        levels.append(_bloom(encoded, n, 0.5, 1000 * len(levels), max_words))
        encoded = known.where(F.col("c") == 1 - len(levels) % 2)
        for before in levels[1:]:
            encoded = encoded.where(before.might_contain(F.col("key")))
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", max_shapes: int = 10_000
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every page.

    ``rules`` has ``rule`` (host and path, such as ``example.com/en/``) and ``verdict`` (allow or
    block); the longest rule that fits wins, and a rule under both verdicts blocks. A url that no
    rule fits is in no list: its rule is null and it is allowed. Null urls have an empty host and
    path. Columns of ``pages`` with the added names are replaced. ``max_shapes`` bounds the
    different (labels, path length) pairs of the rules, more raise an error.
    """
    host, path = url_parts(F.col("_page")[url_col])
    parted = pages.select(F.struct("*").alias("_page")).withColumns({"host": host, "path": path})
    split = rules.where("rule is not null").select(
        "rule",
        "verdict",
        F.substring_index("rule", "/", 1).alias("host"),
    )
    split = split.select(
        F.concat(F.translate("host", _UPPER, _LOWER), F.expr("substr(rule, length(host) + 1)")).alias(
            "key"
        ),
        "verdict",
        F.size(F.split("host", "\\.")).alias("labels"),
        F.expr("length(rule) - length(host)").alias("chars"),
    )
    shapes = [
        (r[0], r[1])
        for r in collect_bounded(
            split.select("labels", "chars").distinct().orderBy("labels", "chars"),
            max_shapes,
            "rule shapes",
        )
    ]
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    kept = [F.col("_page")[c].alias(c) for c in own]
    if not shapes:
        return parted.select(
            *kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")
        )
    grid = F.split(F.lit(",".join(f"{a}:{b}" for a, b in shapes)), ",")

    def key(shape: Column) -> Column:
        labels = F.substring_index(shape, ":", 1).cast("int")
        chars = F.substring_index(shape, ":", -1).cast("int")
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -labels)
        return F.when(
            F.length("path") >= chars, F.concat(suffix, F.call_function("left", F.col("path"), chars))
        )

    keyed = parted.withColumn("keys", F.filter(F.transform(grid, key), lambda k: k.isNotNull()))
    universe = keyed.select(F.explode("keys").alias("key"))
    cascades = {
        verdict: build_cascade(split.where(F.col("verdict") == verdict), universe)
        for verdict in ("block", "allow")
    }

    def judged(k: Column) -> Column:
        verdict = F.when(listed(k, cascades["block"]), "block").when(
            listed(k, cascades["allow"]), "allow"
        )
        return F.struct(F.length(k).alias("n"), k.alias("rule"), verdict.alias("verdict"))

    hits = F.filter(F.transform("keys", judged), lambda h: h["verdict"].isNotNull())
    best = F.array_max(hits)
    return keyed.withColumn("_best", best).select(
        *kept,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit("allow")).alias("verdict"),
    )


RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def _case_sql(what: str) -> str:
    arms = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        value = rule if what == "rule" else verdict
        arms.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}'))"
            f" AND starts_with(path, '{slash}{path}') THEN '{value}'"
        )
    return f"CASE {' '.join(arms)} {'' if what == 'rule' else chr(39).join(['ELSE ', 'allow', ''])} END"


URL_SQL = f"""
WITH a AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0
      THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b)
SELECT page_id, host, path, {_case_sql("rule")} AS rule, {_case_sql("verdict")} AS verdict
FROM c"""


@query("op2_url_filters", URL_SQL)
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of the five fixed rules on every page."""
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
