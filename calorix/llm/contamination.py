"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask laid over consecutive tokens; the masked-out positions are ignored, so a
changed token there does not hide the overlap. The masks are chosen so that every allowed set of
changed tokens leaves one seed of the stretch unchanged (:func:`covering_masks`). Seeds of the texts are joined with the seeds of
the benchmark, each hit names a diagonal (text position minus item position), and the tokens
along that diagonal are compared around the hit: an overlap counts if some stretch of ``stretch``
tokens agrees in at least ``share`` of them. The benchmark's seeds are broadcast if they are few;
the texts are never shuffled for the seed join, and only texts with a hit are read again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.session import collect_bounded, durable


@dataclass(frozen=True)
class SeedRules:
    """mask_count: masks for a length of stretch, at most; fewer read fewer tokens each. Items shorter
    than ``stretch`` are compared whole, with masks for their length. max_broadcast: benchmark seeds
    up to this number are broadcast (16 bytes each), more are joined by shuffle."""

    mask_count: int = 2
    stretch: int = 13
    share: float = 0.8
    max_broadcast: int = 1_000_000


@lru_cache
def covering_masks(n: int, share: float, count: int) -> tuple[str, ...]:
    """At most ``count`` masks (1 reads a token, 0 ignores it) for ``n`` aligned tokens.

    Wherever the tokens differ that may (all but ``share`` of them), one mask at one place reads
    none of them. The masks read as many tokens as so few masks can; a run of tokens between the
    changed ones always does, so a stretch too long to try its patterns gets that.
    """
    changed = min(n - math.ceil(n * share), n - 1)
    best = ("1" * -(-(n - changed) // (changed + 1)),)
    for weight in range(len(best[0]) + 1, n - changed + 1):
        if math.comb(n, changed) * math.comb(n - 1, weight - 1) > 200_000:
            break
        hit = [sum(1 << i for i in some) for some in combinations(range(n), changed)]
        found = {}
        for rest in combinations(range(1, n), weight - 1):
            mask = 1 | sum(1 << i for i in rest)
            places = [mask << at for at in range(n - mask.bit_length() + 1)]
            found[mask] = {i for i, h in enumerate(hit) if any(not h & p for p in places)}
        left, chosen = set(range(len(hit))), []
        while left and len(chosen) < count:
            chosen.append(max(found, key=lambda m: len(found[m] & left)))
            left -= found[chosen[-1]]
        if left:
            break
        best = tuple(f"{m:b}"[::-1] for m in chosen)
    return best


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def _seeds(hashes: str, masks: list[str]) -> Column:
    """Per mask its number and the seed at every position where it fits."""

    def seed(mask: str) -> Callable[[Column], Column]:
        read = [o for o, c in enumerate(mask) if c == "1"]
        return lambda i: F.xxhash64(F.lit(mask), *[F.get(F.col(hashes), i + o) for o in read])

    return F.array(
        *[
            F.struct(
                F.lit(m).alias("mask"),
                F.when(
                    F.size(hashes) >= len(mask),
                    F.transform(
                        F.sequence(F.lit(0), F.size(hashes) - len(mask)),
                        seed(mask),
                    ),
                ).alias("seeds"),
            )
            for m, mask in enumerate(masks)
        ]
    )


def _spread(df: DataFrame, masks: list[str], position: str) -> DataFrame:
    """One row per seed: the other columns, ``mask``, ``position`` and ``seed``."""
    own = [c for c in df.columns if c != "hashes"]
    per_mask = df.select(*own, F.explode(_seeds("hashes", masks)).alias("s"))
    return per_mask.select(*own, "s.mask", F.posexplode("s.seeds").alias(position, "seed"))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rules: SeedRules | None = None,
) -> DataFrame:
    """Overlaps of texts with benchmark items: ``k1, k2, item_id, matched, compared, start``.

    ``k1, k2`` are the text's fingerprint (:func:`fingerprint`), so repeated texts are judged once;
    there is one row per text and item, that of the stretch with most matches. Items of the same
    tokens count as the one with the smallest id. Null and empty texts and items overlap with
    nothing; empty tables give no rows.
    """
    rules = rules or SeedRules()
    items = (
        benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("item"))
        .where("size(item) > 0")
        .groupBy("item")
        .agg(F.min("item_id").alias("item_id"))
    )
    items = durable(items, "benchmark")
    width = F.least(F.size("item"), F.lit(rules.stretch))
    widths = collect_bounded(items.select(width.alias("n")).distinct(), rules.stretch)
    # the widths that use a mask
    users: dict[str, list[int]] = {}
    for n in sorted({r.n for r in widths} or {rules.stretch}):
        for mask in covering_masks(n, rules.share, rules.mask_count):
            users.setdefault(mask, []).append(n)
    masks = list(users)
    hashed = items.withColumn("hashes", F.transform("item", lambda t: F.xxhash64(t)))
    uses = F.lit(False)
    for m, mask in enumerate(masks):
        uses = uses | ((F.col("mask") == m) & F.col("n").isin(users[mask]))
    wanted = _spread(hashed.select("item_id", "hashes", width.alias("n")), masks, "at").where(uses)
    wanted = durable(wanted.select("item_id", "mask", "at", "seed").distinct(), "benchmark-seeds")
    if wanted.count() <= rules.max_broadcast:
        wanted = F.broadcast(wanted)
    text = F.col(text_col)
    hashed = docs.where(text.isNotNull()).select(
        *fingerprint(text), F.transform(tokens(text), lambda t: F.xxhash64(t)).alias("hashes")
    )
    hits = (
        _spread(hashed, masks, "pos")
        .join(wanted, ["mask", "seed"])
        .select("k1", "k2", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
        .distinct()
    )
    hits = durable(hits, "seed-hits")
    texts = docs.select(text.alias("t"), *fingerprint(text)).join(
        hits.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"
    )
    # copies of a text collapse in the first, partial aggregation
    texts = texts.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    read = texts.select("k1", "k2", tokens(F.col("t")).alias("read"))
    pairs = hits.join(read, ["k1", "k2"]).join(items, "item_id")
    agree = F.transform(
        "item", lambda t, j: F.coalesce(_at("read", j + F.col("shift")) == t, F.lit(False)).cast("int")
    )
    width = F.least(F.size("agree"), F.lit(rules.stretch))
    pairs = pairs.select("k1", "k2", "item_id", "shift", agree.alias("agree"))
    pairs = pairs.withColumn("compared", width)
    sums = F.transform(
        F.sequence(F.lit(0), F.size("agree") - F.col("compared")),
        lambda j: F.struct(
            F.aggregate(
                F.slice("agree", j + 1, F.col("compared")), F.lit(0), lambda a, b: a + b
            ).alias("matched"),
            (-(j + F.col("shift"))).alias("back"),
        ),
    )
    best = pairs.withColumn("best", F.array_max(sums)).where(
        F.col("best.matched") >= F.ceil(F.col("compared") * F.lit(rules.share))
    )
    return (
        best.groupBy("k1", "k2", "item_id")
        .agg(F.max(F.struct("best.matched", "compared", "best.back")).alias("b"))
        .select("k1", "k2", "item_id", "b.matched", "b.compared", (-F.col("b.back")).alias("start"))
    )


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def fingerprint(text: Column) -> list[Column]:
    """128 bits of a text, ``k1`` and ``k2``."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("k2")]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    rules: SeedRules | None = None,
) -> DataFrame:
    """``docs`` without the rows whose text overlaps with a benchmark item; null texts stay."""
    found = durable(
        find_overlaps(docs, benchmark, text_col, rules=rules).select("k1", "k2").distinct(), "leaks"
    )
    keyed = docs.select(F.struct("*").alias("row")).select(
        "row", *fingerprint(F.col("row")[text_col])
    )
    return keyed.join(found, ["k1", "k2"], "left_anti").select("row.*")


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that overlap, with the best stretch."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = durable(find_overlaps(docs, table(spark, folder, "benchmark")), "overlaps")
    keyed = docs.select("doc_id", *fingerprint(F.col("text")))
    return keyed.join(found, ["k1", "k2"]).select(
        "doc_id", "item_id", "matched", "compared", "start"
    )
