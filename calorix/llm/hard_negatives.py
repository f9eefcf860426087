"""Hard negatives: for each anchor and positive the best rows of other labels under a score window.

A positive's score is the upper limit of its window, a share of it the lower limit; the windows of
an anchor overlap. The upper limits, in falling order, cut the scores into disjoint slots, and a
row falls into the last slot whose limit it does not exceed. Tasks keep the best few of each slot
for the rows they see, partial results merge by slot, and since every slot lies above the next one,
the best under a limit are those of its slot followed by those of the slots below: each window is
the start of a suffix of one short list.

Anchors are a stated set compared with all rows, in blocks: a cell of the grid holds one block of
anchors of bounded size with its short lists while one share of the rows streams past. Positives
are found the same way, with one slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.llm.centroid_clusters import whole_vector
from calorix.llm.text import mix
from calorix.session import durable

LEAST = np.int64(-(2**62))


@dataclass(frozen=True)
class NegativeRules:
    """positives, negatives: kept per anchor and per window; num/den: lower limit as a share of the
    positive's score; scale: a component is floor(scale * x); anchors: of a block, held by one task;
    shares: of the rows, each streamed by one task for each block; rows: of a packed piece."""

    positives: int = 5
    negatives: int = 5
    num: int = 80
    den: int = 100
    scale: int = 256
    anchors: int = 65_536
    shares: int = 16
    rows: int = 512


def usable_rows(df: DataFrame, id_col: str, vector_col: str, label: Column, rules: NegativeRules):
    """The written table ``row, id, label, v`` of the rows that take part, the longest vector's length
    and the largest magnitude of a component."""
    own = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole_vector(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * rules.scale).cast("long"))
    own = own.select("id", "label", whole.alias("v"))
    held = durable(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    about = held.agg(
        F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))
    ).first()
    return held, max(1, about[0] or 0), about[1] or 0


def score_type(size: int, largest: int) -> type:
    """The narrowest type whose sums of ``size`` products are exact."""
    top = size * largest * largest
    if top >= 1 << 53:
        raise ValueError("inner products of these components have no exact 53-bit result")
    return np.float32 if top < 1 << 24 else np.float64


_PACKED = "block int, row binary, id binary, label binary, v binary, limits binary"


def packed(frame: DataFrame, size: int, blocks: int, rules: NegativeRules, limits: bool) -> DataFrame:
    """Rows as pieces of at most ``rules.rows``; each belongs to a block by the hash of its rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, label = (batch.column(k).to_numpy() for k in range(3))
            lists = batch.column(3)
            n = lists.value_lengths().to_numpy()
            v = np.zeros((len(row), size), np.int32)
            v[np.arange(size) < n[:, None]] = lists.flatten().to_numpy()
            upper = np.stack(batch.column(4).to_numpy(zero_copy_only=False)) if limits and len(row) else None
            block = (mix(row.astype(np.uint64) + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            out = []
            edges = np.searchsorted(block[order], np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                for lo in range(edges[b], edges[b + 1], rules.rows):
                    at = order[lo : min(lo + rules.rows, edges[b + 1])]
                    out.append(
                        (b, row[at].tobytes(), ids[at].tobytes(), label[at].tobytes(), v[at].tobytes(),
                         upper[at].astype(np.int64).tobytes() if limits else b"")
                    )
            names = [f.split()[0] for f in _PACKED.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    columns = ["row", "id", "label", "v", *(["limits"] if limits else [])]
    return frame.select(*columns).mapInArrow(pack, _PACKED)


class SlotLists:
    """The best ``keep`` rows of each slot of a block of anchors: larger scores, then smaller ids."""

    def __init__(self, row, ids, label, v, limits, keep: int, lower: np.ndarray, same: bool):
        self.row, self.label, self.v, self.limits = row, label, v, limits
        self.keep, self.lower, self.same = keep, lower, same
        shape = (*limits.shape, keep)
        self.score = np.full(shape, LEAST)
        self.id = np.full(shape, np.iinfo(np.int64).max)

    def see(self, row, ids, label, v) -> None:
        for lo in range(0, len(self.row), 1024):
            cut = slice(lo, lo + 1024)
            score = self.v[cut] @ v.T
            fits = (self.label[cut, None] == label) == self.same
            if self.same:
                fits &= self.row[cut, None] != row
            else:
                fits &= (score >= self.lower[cut, None]) & (score <= self.limits[cut, :1])
            fits &= score >= self.score[cut, :, -1].min(axis=1)[:, None]
            a, r = np.nonzero(fits)
            if not len(a):
                continue
            s = score[a, r].astype(np.int64)
            a += lo
            slot = (self.limits[a] >= s[:, None]).sum(axis=1) - 1
            worst, last = self.score[a, slot, -1], self.id[a, slot, -1]
            better = (s > worst) | ((s == worst) & (ids[r] < last))
            self._merge(a[better], slot[better], s[better], ids[r[better]])

    def _merge(self, a, slot, s, ids) -> None:
        if not len(a):
            return
        slots, keep = self.limits.shape[1], self.keep
        place = a * slots + slot
        known = np.unique(place)
        score, held = self.score.reshape(-1, keep), self.id.reshape(-1, keep)
        place = np.concatenate([np.repeat(known, keep), place])
        s = np.concatenate([score[known].ravel(), s])
        ids = np.concatenate([held[known].ravel(), ids])
        order = np.lexsort((ids, -s, place))
        start = np.searchsorted(place[order], known)
        best = order[start[:, None] + np.arange(keep)]
        score[known], held[known] = s[best], ids[best]

    def found(self) -> pa.RecordBatch:
        a, slot, k = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[a]), pa.array(slot, pa.int32()), pa.array(self.score[a, slot, k]), pa.array(self.id[a, slot, k])],
            names=["anchor", "slot", "score", "id"],
        )


def best_in_slots(
    anchors: DataFrame, rows: DataFrame, size: int, kind: type, blocks: int, rules: NegativeRules, same: bool
) -> DataFrame:
    """``anchor, slot, score, id``: the best rows of every slot of each anchor.

    ``same`` asks for rows of the anchor's label other than itself, else for rows of other labels.
    Each piece of rows goes to one share and once to each block of anchors; each block goes to
    every share. A task gets the anchors of its cell first and keeps them, rows then stream.
    """
    keep = rules.positives if same else rules.negatives
    slots = 1 if same else rules.positives
    shares = rules.shares
    held = packed(anchors, size, blocks, rules, limits=not same)
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(0))
    seen = packed(rows, size, shares, rules, limits=False).withColumnRenamed("block", "share")
    seen = seen.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1))
    columns = ["share", "kind", *[f.split()[0] for f in _PACKED.split(", ")]]
    both = held.select(*columns).unionByName(seen.select(*columns))
    cell = ["block", "share"]
    ordered = both.repartition(*cell).sortWithinPartitions(*cell, "kind").select("block", *columns[:2], *columns[3:])

    def numbers(blob) -> np.ndarray:
        return np.frombuffer(blob, np.int64)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, lists = None, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                block, share, what, *blobs = (batch.column(k)[at].as_py() for k in range(8))
                if (block, share) != now:
                    if lists is not None:
                        yield lists.found()
                    now, pieces, lists = (block, share), [], None
                if what == 0:
                    pieces.append(blobs)
                    continue
                if not pieces and lists is None:
                    continue
                if lists is None:
                    lists, pieces = gathered(pieces), []
                row, ids, label = (numbers(b) for b in blobs[:3])
                lists.see(row, ids, label, np.frombuffer(blobs[3], np.int32).reshape(-1, size).astype(kind))
        if lists is not None:
            yield lists.found()

    def gathered(pieces: list) -> SlotLists:
        row, ids, label, v, limits = (b"".join(c) for c in zip(*pieces, strict=True))
        row, ids, label = numbers(row), numbers(ids), numbers(label)
        v = np.frombuffer(v, np.int32).reshape(-1, size).astype(kind)
        if same:
            upper = np.full((len(row), 1), np.iinfo(np.int64).max)
            lower = np.full(len(row), LEAST)
        else:
            upper = numbers(limits).reshape(-1, slots)
            # the least score of any window; empty windows (negative limits) have none
            asked = np.where(upper >= 0, -(-upper * rules.num // rules.den), np.iinfo(np.int64).max)
            lower = asked.min(axis=1)
        return SlotLists(row, ids, label, v, upper, keep, lower, same)

    parts = ordered.mapInArrow(stream, "anchor long, slot int, score long, id long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return parts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep)


def mine_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    rules: NegativeRules | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the column ``id``. Rows without id, label or vector, or with a
    component that is null or not finite, take no part; shorter vectors count as filled with zeros.
    Repeated rows are different rows: each can be an anchor, a positive and a negative, and a copy of
    an anchor is one of its positives. Ties go to the smaller id. A negative positive score has an
    empty window. Sums of products beyond 2^53 are an error.
    """
    rules = rules or NegativeRules()
    label = F.col("label") if label is None else label
    rows, size, largest = usable_rows(df, id_col, vector_col, label, rules)
    kind = score_type(size, largest)
    anchors = rows.where(is_anchor)
    blocks = max(1, -(-anchors.count() // rules.anchors))
    positives = best_in_slots(anchors, rows, size, kind, blocks, rules, same=True)
    positives = durable(positives.select("anchor", "k", "score", "id"), "positives")
    # limits in falling order; the last one is repeated where there are fewer positives
    limits = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s")))).alias("p"))
    limits = limits.select(
        F.col("anchor").alias("row"),
        F.transform(
            F.sequence(F.lit(0), F.lit(rules.positives - 1)),
            lambda k: -F.get("p", F.least(k, F.size("p") - 1))["s"],
        ).alias("limits"),
    )
    asked = durable(anchors.join(limits, "row"), "anchors")
    lists = best_in_slots(asked, rows, size, kind, blocks, rules, same=False)
    # slots lie above each other, so one list in order of slot and rank is in order of score
    lists = lists.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "k", "score", "id"))).alias("list"))
    windows = positives.join(lists, "anchor").join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "limits"), "anchor")
    # the suffix under the positive's limit, down to its lower limit; equal limits have the last one's slot
    slot = F.size(F.filter("limits", lambda p: p >= F.col("score"))) - 1
    suffix = F.filter(
        "list", lambda x: (x["slot"] >= slot) & (x["score"] * rules.den >= F.col("score") * rules.num)
        & (x["score"] <= F.col("score")),
    )
    top = windows.select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.posexplode(F.slice(suffix, 1, rules.negatives)).alias("at", "x"),
    )
    return top.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
        "positive_score", F.col("x.score").alias("negative_score"),
    )


SQL = """
WITH ints AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS MATERIALIZED (
        SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
            list_inner_product(a.v, b.v)::BIGINT AS s
        FROM ints a JOIN ints b ON a.vec_id % 100 = 0 AND a.r != b.r),
    positives AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, other) AS k FROM scored WHERE alike)
        WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.s AS positive_score, n.s AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.s DESC, n.other) AS rank
    FROM positives p JOIN scored n ON n.a = p.a AND NOT n.alike AND 80 * p.s <= 100 * n.s AND n.s <= p.s)
WHERE rank <= 5
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives for every hundredth id, with every seventh id's label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=label)
