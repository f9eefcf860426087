"""Repeated byte strings by column-wise suffix sorting of many fragments at once.

1. Of the 32-byte grams of each 400-byte window the one with the least hash is the window's
   anchor. Equal windows have equal anchors at the same place in them, so only windows around an
   anchor that occurs twice can recur. Anchors, about one in 185 bytes, are counted.
2. Each occurrence of a recurring anchor becomes a fragment: the bytes of the windows that have it
   as their anchor, at most 368 on either side. Fragments of one anchor are lined up at it.
   Where an anchor has more fragments than one task should take, its windows are dealt over bins
   of 24 neighbouring places around it, and a bin over its cores: the 377 bytes that all windows of
   the bin share. Equal windows have equal cores. Cores are counted as anchors are, and those that
   still have too many fragments go by single windows.
3. The fragments of a task are sorted by their suffixes column by column: every round inserts one
   more symbol of each fragment on the left, which reorders the suffixes by a stable sort on that
   symbol, as one step of a Burrows-Wheeler transform does, and updates the common prefixes of
   neighbours. A window recurs if its suffix shares 400 bytes with a neighbour.
4. Every document drops the bytes that its recurring windows cover.

The rounds are as many as a fragment has columns, not as the longest document has bytes, and the
order and prefixes of a batch of fragments stay in memory; the external files of the classic
construction, one set for the whole collection rewritten every round, become Spark's shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from calorix.llm.base import query, recurring, shard_count, table
from calorix.llm.text import (
    byte_hashes,
    chunks,
    mix,
    ranges,
    run_hashes,
    run_of,
    text_bytes,
    window_minima,
    windows,
)


@dataclass(frozen=True)
class StringRules:
    """size: bytes of a window; gram: bytes of an anchor; shard_bytes: text of a shard;
    batch: fragments that are sorted together, one group's fragments always are;
    many: fragments of a group above which it is split, four a shard at least;
    widths: windows of a bin, by level of splitting; groups of the last level are not split."""

    size: int = 400
    gram: int = 32
    shard_bytes: int = 4_000_000
    batch: int = 4_000
    many: int = 4_000
    widths: tuple[int, ...] = (24, 1)

    @property
    def reach(self) -> int:
        """Bytes on one side of an anchor that a window around it can reach."""
        return self.size - self.gram


def anchors(
    data: np.ndarray, offsets: np.ndarray, rules: StringRules
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all windows that lie inside one text, their hashes, and where the
    first and the last window of each anchor start."""
    grams = windows(byte_hashes(data), rules.gram)
    place = window_minima(grams, rules.reach + 1)
    starts = np.maximum(np.diff(offsets) - rules.size + 1, 0)
    some = starts > 0
    edge = np.zeros(len(data) + 1, np.int32)
    edge[offsets[:-1][some]] += 1
    edge[offsets[:-1][some] + starts[some]] -= 1
    window = np.flatnonzero(np.cumsum(edge)[: len(place)] > 0)
    place = place[window]
    # neighbouring windows mostly have the same anchor, and an anchor's windows are neighbours
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    place = place[at[:-1]]
    return place, grams[place], window[at[:-1]], window[at[1:] - 1]


def binned(
    data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, width: int,
    rules: StringRules,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows from ``first`` to ``last`` of each anchor by bins of ``width`` places around it:
    number of the anchor, hash of the bin's core, first and last window."""
    zero = place - rules.reach
    low = (first - zero) // width
    counts = (last - zero) // width - low + 1
    each, number = run_of(counts), ranges(low, counts)
    begin = zero[each] + number * width
    end = np.minimum(begin + width - 1, place[each])
    core = run_hashes(byte_hashes(data), end, begin + rules.size)
    core = mix(core ^ mix((number + 1).astype(np.uint64)))
    return each, core, np.maximum(first[each], begin), np.minimum(last[each], end)


#: Sorted keys of a level and whether each is split; levels in order.
Known = list[tuple[np.ndarray, np.ndarray]]
#: Place of the anchor, key, first and last window.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def located(
    data: np.ndarray, offsets: np.ndarray, known: Known, rules: StringRules
) -> tuple[list[Runs], Runs]:
    """Runs of windows under the known keys that are not split, by level, and the runs, by bins of
    the next level, of those that all known levels split."""
    place, key, first, last = anchors(data, offsets, rules)
    kept = []
    for level in range(len(rules.widths) + 1):
        if level:
            each, key, first, last = binned(data, place, first, last, rules.widths[level - 1], rules)
            place = place[each]
        if level == len(known):
            break
        wanted, split = known[level]
        near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = wanted[near] == key if len(wanted) else np.zeros(len(key), bool)
        cut = hit & split[near] if len(wanted) else hit
        kept.append(tuple(x[hit & ~cut] for x in (place, key, first, last)))
        place, key, first, last = (x[cut] for x in (place, key, first, last))
    return kept, (place, key, first, last)


def levels(keys: pa.Table, upto: int) -> Known:
    """The keys of a shard by level."""
    level, key = keys["level"].to_numpy(), keys["key"].to_numpy().view(np.uint64)
    split = keys["split"].to_numpy()
    out = []
    for k in range(upto):
        mine = np.flatnonzero(level == k)
        mine = mine[np.argsort(key[mine])]
        out.append((key[mine], split[mine]))
    return out


def forms(data: np.ndarray, runs: Runs, rules: StringRules) -> np.ndarray:
    """Equal for equal fragments of a key."""
    place, _, first, last = runs
    whole = run_hashes(byte_hashes(data), first, last + rules.size)
    return mix(whole ^ (place - first).astype(np.uint64))


def tallied(keys: np.ndarray, shards: np.ndarray, form: np.ndarray) -> pa.RecordBatch:
    """Distinct keys of each shard with the times they are found and the different fragments."""
    order = np.lexsort((form, shards, keys))
    keys, shards, form = keys[order], shards[order], form[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (shards[1:] != shards[:-1])
    other = new.copy()
    other[1:] |= form[1:] != form[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(keys)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[at].view(np.int64)),
            pa.array(shards[at].astype(np.int32)),
            pa.array(n, pa.int64()),
            pa.array(np.add.reduceat(other, at, dtype=np.int64) if len(at) else n, pa.int64()),
        ],
        names=["key", "shard", "n", "forms"],
    )


def recurring_columns(
    symbols: np.ndarray, group: np.ndarray, size: int, last: int
) -> np.ndarray:
    """For each fragment (row) and column up to ``last``: whether the ``size`` symbols from there
    equal those of another fragment of its group. Rows of a group are next to each other."""
    n, width = symbols.shape
    order = np.arange(n)
    # of the empty suffix: rows of a group agree in nothing
    common = np.zeros(n, np.int32)
    out = np.zeros((n, last + 1), bool)
    base = group.astype(np.int64) * 512
    for c in range(width - 1, -1, -1):
        key = base[order] + symbols[order, c]
        step = np.argsort(key, kind="stable")
        sorted_key = key[step]
        joined = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
        a, b = step[joined - 1], step[joined]
        fresh = np.zeros(n, np.int32)
        fresh[joined] = common[b] + 1
        far = np.flatnonzero(b > a + 1)
        if len(far):
            # rows that were apart share what all between them shared
            pairs = np.empty(2 * len(far), np.int64)
            pairs[0::2], pairs[1::2] = a[far] + 1, b[far] + 1
            safe = np.append(common, 0)
            fresh[joined[far]] = np.minimum.reduceat(safe, np.minimum(pairs, n))[0::2] + 1
        order, common = order[step], fresh
        if c <= last:
            reach = common >= size
            hit = reach.copy()
            hit[:-1] |= reach[1:]
            out[order, c] = hit
    return out


def sharded(
    docs: DataFrame, id_col: str, text_col: str, shards: int, also: list[Column] | None = None
) -> DataFrame:
    """``shard, uid, doc_id, text`` and the columns ``also``. Rows are dealt by a hash of id and text,
    which is also the ``uid``: rows that agree in both lose the same bytes."""
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    return docs.select(
        F.pmod(uid, F.lit(shards)).cast("int").alias("shard"),
        uid.alias("uid"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *(also or []),
    )


_FOUND = "key long, shard int, n long, forms long"
_FRAGMENTS = "key long, shard int, left int, bytes binary, uids array<long>, starts array<long>"
_SPANS = "shard int, uid long, start long, stop long"


def recurring_keys(texts: DataFrame, rules: StringRules, many: int) -> DataFrame:
    """``shard, level, key, split`` of what recurs: anchors (level 0), and for those with more than
    ``many`` fragments the cores of their windows, by level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offsets):
                at = offsets[lo : hi + 1]
                part, at = data[at[0] : at[-1]], at - at[0]
                runs = anchors(part, at, rules)
                of = shard[lo:hi][np.searchsorted(at, runs[0], "right") - 1]
                yield tallied(runs[1], of, forms(part, runs, rules))

    def judged(found: DataFrame, level: int) -> DataFrame:
        split = F.col("forms") > many if level < len(rules.widths) else F.lit(False)
        keys = recurring(found, "key", "forms")
        return keys.select("shard", F.lit(level).alias("level"), "key", split.alias("split"))

    def counter(level: int):
        def count_bins(left: pa.Table, right: pa.Table) -> pa.Table:
            data, offsets = text_bytes(left["text"])
            known = levels(right, level)
            keys, form = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for lo, hi in chunks(offsets) if len(known[-1][0]) else ():
                part = data[offsets[lo] : offsets[hi]]
                _, runs = located(part, offsets[lo : hi + 1] - offsets[lo], known, rules)
                keys.append(runs[1])
                form.append(forms(part, runs, rules))
            found = np.concatenate(keys)
            shard = left["shard"][0].as_py() if len(left) else 0
            shards = np.full(len(found), shard)
            return pa.Table.from_batches([tallied(found, shards, np.concatenate(form))])

        return count_bins

    found = texts.select("shard", "text").mapInArrow(count, _FOUND)
    keys = judged(found, 0)
    for level in range(1, len(rules.widths) + 1):
        near = texts.groupBy("shard").cogroup(keys.where("split").groupBy("shard"))
        keys = keys.unionByName(judged(near.applyInArrow(counter(level), _FOUND), level))
    return keys


def recurring_spans(texts: DataFrame, rules: StringRules, many: int) -> DataFrame:
    """``shard, uid, start, stop``: byte ranges covered by recurring windows; they may overlap."""
    keys = recurring_keys(texts, rules, many)

    def fragments(left: pa.Table, right: pa.Table) -> pa.Table:
        known = levels(right, len(rules.widths) + 1)
        data, offsets = text_bytes(left["text"])
        uids = left["uid"].to_numpy()
        held: dict = {}
        for lo, hi in chunks(offsets) if len(right) else ():
            at = offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            kept, _ = located(part, at, known, rules)
            place, key, a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
            text = np.searchsorted(at, place, "right") - 1
            b = b + rules.size
            raw = part.tobytes()
            for k, p, x, y, t, begin in zip(
                key.view(np.int64).tolist(), place.tolist(), a.tolist(), b.tolist(),
                uids[lo:hi][text].tolist(), at[text].tolist(), strict=True,
            ):
                where = held.setdefault((k, p - x, raw[x:y]), ([], []))
                where[0].append(t)
                where[1].append(x - begin)
        shard = left["shard"][0].as_py() if len(left) else 0
        names = ["key", "left", "bytes"]
        columns = list(zip(*held, strict=True)) or [[], [], []]
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        made = {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)}
        where = list(zip(*held.values(), strict=True)) or [[], []]
        lists = pa.list_(pa.int64())
        return pa.table(
            {
                "key": made["key"],
                "shard": pa.array([shard] * len(held), pa.int32()),
                "left": made["left"],
                "bytes": made["bytes"],
                "uids": pa.array(where[0], lists),
                "starts": pa.array(where[1], lists),
            }
        )

    # all columns, as the last step needs them: one shuffle of the texts serves both
    cut = texts.groupBy("shard").cogroup(keys.groupBy("shard"))
    lined = cut.applyInArrow(fragments, _FRAGMENTS).repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, new]) if rest is not None else new
            key = rest["key"].to_numpy()
            # all but the last anchor, of which more may follow
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield from _compared(rest.slice(0, whole), rules)
                rest = rest.slice(whole)
        if rest is not None and len(rest):
            yield from _compared(rest, rules)

    return lined.mapInArrow(compare, _SPANS)


def _compared(table: pa.Table, rules: StringRules) -> Iterator[pa.RecordBatch]:
    """Spans of whole groups of fragments, some groups at a time."""
    key = table["key"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + rules.batch, "right")) - 1)
        a, b = first[lo], first[hi] if hi < len(first) else len(key)
        yield _spans(table.slice(a, b - a).combine_chunks(), rules)
        lo = hi


def _spans(table: pa.Table, rules: StringRules) -> pa.RecordBatch:
    key, left = table["key"].to_numpy(), table["left"].to_numpy()
    data, offsets = text_bytes(table["bytes"])
    n, width = len(table), rules.reach + rules.size
    size = np.diff(offsets)
    symbols = np.full(n * width, 256, np.int16)
    for lo in range(0, n, 512):  # numbers of places take more than the symbols
        hi = min(n, lo + 512)
        begin = np.arange(lo, hi) * width + rules.reach - left[lo:hi]
        symbols[ranges(begin, size[lo:hi])] = data[offsets[lo] : offsets[hi]]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if n else key
    repeated = recurring_columns(symbols.reshape(n, width), group, rules.size, rules.reach)
    counts = np.diff(table["uids"].chunk(0).offsets.to_numpy()) if n else size
    repeated[counts > 1] = True
    # windows inside the fragment only
    column = np.arange(rules.reach + 1)
    repeated &= column >= (rules.reach - left)[:, None]
    repeated &= column + rules.size <= (rules.reach - left + size)[:, None]
    padded = np.zeros((n, rules.reach + 3), np.int8)
    padded[:, 1:-1] = repeated
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change > 0)
    stop = np.nonzero(change < 0)[1] - 1 + rules.size
    # each run once for every place the fragment stands at
    each = np.repeat(np.arange(len(row)), counts[row])
    lists = table["uids"].chunk(0) if n else pa.array([], pa.list_(pa.int64()))
    at = lists.offsets.to_numpy()
    place = ranges(at[row], counts[row])
    uids = lists.values.to_numpy()[place]
    base = table["starts"].chunk(0).values.to_numpy()[place] if n else uids
    base = base - (rules.reach - left[row[each]])
    shards = table["shard"].to_numpy()[row[each]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shards, pa.int32()),
            pa.array(uids, pa.int64()),
            pa.array(base + start[each], pa.int64()),
            pa.array(base + stop[each], pa.int64()),
        ],
        names=["shard", "uid", "start", "stop"],
    )


def remove_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: StringRules | None = None,
    carry: list[str] | None = None,
    as_text: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) and, if named, ``row`` with the columns
    ``carry`` for every row of ``docs``.

    Removed is each byte in a string of ``size`` bytes that also starts at another place of any
    text, the same one included. Strings are judged on the input and do not cross texts. Null
    and empty texts have no bytes; of repeated rows all copies go. ``A string may begin or
    end inside a character: ``kept`` then has the rest of it, and with ``as_text``, where it is a
    string, drops that rest.
    """
    rules = rules or StringRules()
    also = [F.struct(*carry).alias("row")] if carry else []
    shards = shard_count(docs, text_col, rules.shard_bytes)
    texts = sharded(docs, id_col, text_col, shards, also)
    spans = recurring_spans(texts, rules, max(rules.many, 4 * shards))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = text_bytes(left["text"])
        by_uid = np.argsort(left["uid"].to_numpy(), kind="stable")
        uids = left["uid"].to_numpy()[by_uid]
        uid, start, stop = (right[c].to_numpy() for c in ("uid", "start", "stop"))
        a, b = np.searchsorted(uids, uid), np.searchsorted(uids, uid, "right")
        text, each = by_uid[ranges(a, b - a)], run_of(b - a)
        order = np.argsort(text, kind="stable")
        text, each = text[order], each[order]
        kept, n_removed, n_spans = [], [], []
        for lo, hi in chunks(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            mine = slice(*np.searchsorted(text, [lo, hi]))
            edge = np.zeros(len(part) + 1, np.int32)
            base, span = at[text[mine] - lo], each[mine]
            np.add.at(edge, base + start[span], 1)
            np.add.at(edge, base + stop[span], -1)
            gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begin = at[:-1][np.diff(at) > 0]
            opens[begin] = gone[begin]
            total, runs = (
                np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (gone, opens)
            )
            n_removed.append(np.diff(total[at]))
            n_spans.append(np.diff(runs[at]))
            for x, y, n in zip(at[:-1], at[1:], n_removed[-1], strict=True):
                kept.append((part[x:y][~gone[x:y]] if n else part[x:y]).tobytes())
        empty = np.zeros(0, np.int64)
        made = {
            "doc_id": left["doc_id"],
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(np.concatenate([empty, *n_removed]), pa.int64()),
            "n_spans": pa.array(np.concatenate([empty, *n_spans]), pa.int64()),
            "kept": pa.array([k.decode(errors="ignore") for k in kept], pa.string())
            if as_text
            else pa.array(kept, pa.binary()),
        }
        return pa.table(made | ({"row": left["row"]} if carry else {}))

    near = texts.groupBy("shard").cogroup(spans.groupBy("shard"))
    schema = StructType([texts.schema["doc_id"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema.add(name, LongType())
    schema.add("kept", StringType() if as_text else BinaryType())
    return near.applyInArrow(cut, schema.add(texts.schema["row"]) if carry else schema)


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses of its repeated byte strings."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_strings(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
