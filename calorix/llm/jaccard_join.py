"""Similarity join of texts on word shingles by PartEnum signatures.

A text is the set of its hashed shingles; equal sets are one node from the start. Two sets of
sizes a and b with Jaccard similarity s or more differ in at most (a + b)(1 - s)/(1 + s)
elements. Sets are grouped in bands of about equal size; in a band the hashed domain is cut into
parts, each part into three sections, and the content of every two sections of a part is a
signature. The differences of a similar pair are too few to touch two sections of every part, so
the pair shares a signature, whichever elements differ.

Two facts keep this small and exact. An element that only one set holds is in no intersection, so
sets are first reduced to their shared elements, and a set that keeps less than the share s of
its elements is similar to nothing: most sets end here, also those that share a common passage.
And a signature of empty sections says nothing: a set with too many of them has its signatures
taken again with another cut, which reaches every pair of such sets.

Sets that share a signature are compared in blocks, as rows of a matrix whose product with itself
counts common elements; of the similar ones only the links of a spanning tree leave the task, so a
group of thousands of near copies never becomes a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, shard_count, similar_sql, table
from calorix.llm.text import (
    chunks,
    mix,
    ranges,
    run_of,
    span_hashes,
    text_bytes,
    windows,
    word_spans,
)
from calorix.session import durable, few

U = np.uint64


@dataclass(frozen=True)
class JoinRules:
    """words: of a shingle; num/den: least similarity; part: elements of the largest set of a band
    in one part; cuts: tries before sets with many empty sections are compared with each other;
    bucket_bytes: text whose shingles are counted by one task; flush: shingles a task gathers;
    block: sets that are compared with each other at once."""

    words: int = 5
    num: int = 75
    den: int = 100
    part: float = 6.3
    cuts: int = 6
    bucket_bytes: int = 12_000_000
    flush: int = 1_500_000
    block: int = 1_500

    def band_starts(self, up_to: int) -> list[int]:
        """First sizes of the bands; a similar set is in the same or a neighbouring band."""
        starts = [1]
        while starts[-1] <= up_to:
            starts.append(starts[-1] * self.den // self.num + 1)
        return starts

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most elements in which similar sets of these sizes can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def shingle_sets(
    column: pa.Array, rules: JoinRules
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the distinct shingles of each text in order, their number, the set's id.

    A-Z are folded. A text of fewer words than a shingle is one shingle of all its words. Shingles
    and ids are 64-bit hashes; an empty set has id 0.
    """
    data, offsets = text_bytes(column)
    size = rules.words
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = word_spans(part, at)
        words = span_hashes(part, starts, ends, fold=True)
        n_words = np.diff(first)
        found = windows(words, size)
        n = np.maximum(n_words - size + 1, 0)
        elements, owner = found[ranges(first[:-1], n)], run_of(n)
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        if len(short):
            whole = np.array(
                [_whole(words[first[i] : first[i + 1]]) for i in short.tolist()], dtype=U
            )
            elements, owner = np.concatenate([elements, whole]), np.concatenate([owner, short])
        order = np.lexsort((elements, owner))
        elements, owner = elements[order], owner[order]
        new = np.ones(len(elements), bool)
        new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        elements, owner = elements[new], owner[new]
        counts = np.bincount(owner, minlength=hi - lo)
        yield elements, counts, set_ids(elements, counts)


def _whole(words: np.ndarray) -> np.uint64:
    total = U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            total = mix(np.array([total * U(31) + w], U))[0]
    return total


def set_ids(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(elements ^ U(0x5851F42D4C957F2D)), dtype=U)])
    ends = np.cumsum(counts)
    return np.where(counts > 0, mix(total[ends] - total[ends - counts] + counts.astype(U)), U(0))


def _rows(sids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, elements: np.ndarray) -> pa.Table:
    """``sid, n, elements`` of the owners that have elements; ``owner`` is in order."""
    held, first = np.unique(owner, return_index=True)
    blob = elements.tobytes()
    at = np.append(first, len(owner)) * 8
    return pa.table(
        {
            "sid": pa.array(sids[held].view(np.int64)),
            "n": pa.array(sizes[held], pa.int32()),
            "elements": pa.array(
                [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()
            ),
        }
    )


def _planes(values: np.ndarray) -> bytes:
    """The upper six bytes of sorted numbers, place by place: the leading bytes of neighbours are
    equal, which a shuffle compresses."""
    return values.view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    upper = np.frombuffer(planes, np.uint8).reshape(6, -1)
    out = np.zeros((upper.shape[1], 8), np.uint8)
    out[:, 2:] = upper.T
    return out.view(U).ravel()


_LISTS = "dest int, sids binary, sizes binary, counts binary, elements binary"
_BLOCKS = f"{_LISTS}, owner binary"
_MANY = 0xFFFF


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def _lists(
    sids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, elements: np.ndarray, buckets: int
) -> list[tuple]:
    """Elements by set, packed into a row for each destination of the sets."""
    to = sids[owner] % U(buckets)
    order = np.lexsort((elements, owner, to))
    owner, elements, to = owner[order], elements[order], to[order]
    rows = []
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else to
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(to)], strict=False):
        held, counts = np.unique(owner[lo:hi], return_counts=True)
        rows.append(
            (int(to[lo]), sids[held].tobytes(), sizes[held].astype(np.int32).tobytes(),
             counts.astype(np.int32).tobytes(), _planes(elements[lo:hi]))
        )
    return rows


def _runs(
    values: np.ndarray, lo: int, hi: int, most: int = 1 << 18
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of values from ``lo`` to before ``hi`` and the places of theirs, about ``most`` each if
    values are spread evenly: what is sorted range by range needs no copies of everything."""
    n = max(1, min(hi - lo, 32, len(values) // most + 1))
    edges = [lo + (hi - lo) * k // n for k in range(n + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        place = np.flatnonzero((values >= a) & (values <= b - 1))
        if len(place):
            yield a, b, place


def _blocks(
    sids: np.ndarray, sizes: np.ndarray, elements: np.ndarray, buckets: int
) -> pa.RecordBatch:
    """What a task has gathered: by bucket, distinct elements with their set, or a mark that several
    sets here hold it; and, by set, the elements that several sets here hold, which need no
    count. An element that most texts hold has one entry per task."""
    keep, first = np.unique(sids, return_index=True)
    first = first[keep != 0]
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(first), dtype=np.uint16), sizes[first])
    # 48 bits of an element are kept: a chance meeting only keeps a set a little longer
    e = elements[ranges(begin[first], sizes[first])] & ~U(0xFFFF)
    sids, sizes = sids[first], sizes[first]
    bucket = (((e >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
    rows, local = [], [(owner[:0], e[:0])]
    for lo, hi, place in _runs(bucket, 0, buckets):
        place = place[np.argsort(e[place], kind="stable")]
        some, of = e[place], owner[place]
        start = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        length = np.diff(np.append(start, len(some)))
        several = np.repeat(length > 1, length)
        local.append((of[several], some[several]))
        some, of = some[start], np.where(length > 1, _MANY, of[start])
        edges = np.searchsorted(bucket[place[start]], np.arange(lo, hi + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            cut = slice(edges[b], edges[b + 1])
            # only the sets this bucket refers to
            used, number = np.unique(of[cut], return_inverse=True)
            real = used[used != _MANY]
            number = np.where(of[cut] == _MANY, _MANY, number).astype(np.uint16)
            rows.append(
                (lo + b, sids[real].tobytes(), sizes[real].astype(np.int32).tobytes(), None,
                 _planes(some[cut]), number.tobytes())
            )
    del e, owner, bucket
    owner, e = map(np.concatenate, zip(*local, strict=True))
    rows += [(*r, None) for r in _lists(sids, sizes, owner, e, buckets)]
    return _batch(rows, _BLOCKS)


def _shared_entries(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Set ids, sizes, owners and elements of the entries whose element several sets hold."""
    held, sids, sizes = [], [], []
    for planes, number, ids, each in zip(
        *(rows[c] for c in ("elements", "owner", "sids", "sizes")), strict=True
    ):
        if number.is_valid:
            held.append((planes.as_buffer(), np.frombuffer(number.as_buffer(), np.uint16)))
            sids.append(np.frombuffer(ids.as_buffer(), U))
            sizes.append(np.frombuffer(each.as_buffer(), np.int32))
    # the same set from several tasks is one owner; a mark belongs to none
    known, first, same = np.unique(
        np.concatenate([np.zeros(0, U), *sids]), return_index=True, return_inverse=True
    )
    sizes = np.concatenate([np.zeros(0, np.int32), *sizes])[first]
    n = sum(len(number) for _, number in held)
    e, owner = np.empty(n, U), np.full(n, -1, np.int32)
    at = base = 0
    for (planes, number), ids in zip(held, sids, strict=True):
        cut = slice(at, at + len(number))
        e[cut] = _numbers(planes)
        real = number != _MANY
        owner[cut][real] = same[number[real] + np.int64(base)]
        at, base = cut.stop, base + len(ids)
    kept = [(owner[:0], e[:0])]
    for _, _, place in _runs(e, int(e.min()), int(e.max()) + 1) if n else ():
        place = place[np.argsort(e[place], kind="stable")]
        some, of = e[place], owner[place]
        start = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        length = np.diff(np.append(start, len(some)))
        least, most = np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)
        keep = np.repeat(least != most, length) & (of >= 0)
        kept.append((of[keep], some[keep]))
    owner, e = map(np.concatenate, zip(*kept, strict=True))
    return known, sizes, owner, e


def shared_sets(docs: DataFrame, text_col: str, rules: JoinRules) -> DataFrame:
    """``sid, n, elements``: sets that keep enough elements when those of a single set are dropped.

    ``n`` is the full size, ``elements`` the shared shingles (48 bits of the hash) in order, 8
    bytes each.
    """
    buckets = shard_count(docs, text_col, rules.bucket_bytes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = texts = 0
        for batch in batches:
            for found in shingle_sets(batch.column(0), rules):
                held.append(found)
                size, texts = size + len(found[0]), texts + len(found[1])
                if size >= rules.flush or texts > 50_000:
                    yield from flush(held)
                    held, size, texts = [], 0, 0
        if held:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        elements, counts, sids = (np.concatenate([h[i] for h in held]) for i in range(3))
        held.clear()
        # owners are numbered with 16 bits
        for lo in range(0, len(counts), _MANY - 1):
            cut = slice(lo, lo + _MANY - 1)
            begin = int(counts[:lo].sum())
            some = elements[begin : begin + int(counts[cut].sum())]
            yield _blocks(sids[cut], counts[cut], some, buckets)

    def shared(found: pa.Table) -> pa.Table:
        local = found.filter(found["counts"].is_valid()).drop_columns(["owner"])
        entries = _shared_entries(found)
        made = _batch(_lists(*entries, buckets), _LISTS)
        return pa.concat_tables([local, pa.Table.from_batches([made])])

    def joined(found: pa.Table) -> pa.Table:
        sids, sizes, counts, e = [np.zeros(0, U)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, U)]
        for a, b, c, d in zip(*(found[c] for c in ("sids", "sizes", "counts", "elements")), strict=True):
            sids.append(np.frombuffer(a.as_buffer(), U))
            sizes.append(np.frombuffer(b.as_buffer(), np.int32))
            counts.append(np.frombuffer(c.as_buffer(), np.int32))
            e.append(_numbers(d.as_py()))
        sids, sizes, counts, e = map(np.concatenate, (sids, sizes, counts, e))
        ids, first, group = np.unique(sids, return_index=True, return_inverse=True)
        owner = np.repeat(group, counts)
        order = np.lexsort((e, owner))
        e, owner = e[order], owner[order]
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]) | (owner[1:] != owner[:-1])
        e, owner = e[new], owner[new]
        n = sizes[first].astype(np.int64)
        enough = np.bincount(owner, minlength=len(ids)) * rules.den >= n * rules.num
        keep = enough[owner]
        return _rows(ids, n, owner[keep], e[keep])

    blocks = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(gather, _BLOCKS)
    parts = blocks.groupBy("dest").applyInArrow(shared, _LISTS)
    return parts.groupBy("dest").applyInArrow(joined, "sid long, n int, elements binary")


def signatures(
    elements: np.ndarray, counts: np.ndarray, n: np.ndarray, rules: JoinRules
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the number of the set of each. ``n`` are the full sizes of the sets."""
    starts = np.array(rules.band_starts(int(n.max()) if len(n) else 1))
    band = np.searchsorted(starts, n, "right") - 1
    begin = np.cumsum(counts) - counts
    out, of = [], []
    for up in (0, 1):
        own = np.arange(len(n))
        if up:
            # as the smaller of a pair with a set of the next band
            own = own[n * rules.den >= starts[np.minimum(band + 1, len(starts) - 1)] * rules.num]
        b = band[own] + up
        top = rules.band_starts(int(n.max()) * 2)
        last = np.array(top)[b + 1] - 1 if len(own) else b
        largest = np.minimum(n[own] * rules.den // rules.num, last)
        differ = rules.differences(n[own], largest)
        parts = np.maximum(
            rules.differences(last, last) // 2 + 1, np.ceil(last / rules.part).astype(np.int64)
        )
        for cut in range(rules.cuts + 1):
            if not len(own):
                break
            tag = mix(b.astype(U) * U(64) + U(cut * 2 + 1))
            if cut == rules.cuts:
                # exact way for what is left: all such sets of the band share one signature
                out.append(tag)
                of.append(own)
                break
            size = counts[own]
            which = run_of(size)
            e = elements[ranges(begin[own], size)]
            m = mix(e + tag[which])
            part = ((m >> U(32)) % parts[which].astype(U)).astype(np.int64)
            section = ((m & U(0xFFFFFFFF)) % U(3)).astype(np.int64)
            base = np.cumsum(parts) - parts
            cell = (base[which] + part) * 3 + section
            cells = int(parts.sum()) * 3
            total = np.zeros(cells, U)
            np.add.at(total, cell, mix(m))
            filled = np.bincount(cell, minlength=cells).reshape(-1, 3) > 0
            total = total.reshape(-1, 3)
            set_of = run_of(parts)
            for left in range(3):
                x, y = (left + 1) % 3, (left + 2) % 3
                some = filled[:, x] | filled[:, y]
                place = np.arange(len(set_of)) - base[set_of]
                sig = mix(
                    total[:, x] * U(0x9E3779B97F4A7C15)
                    + mix(total[:, y])
                    + tag[set_of]
                    + (place * 3 + left).astype(U)
                )
                out.append(sig[some])
                of.append(own[set_of[some]])
            empty = np.bincount(set_of, filled.sum(axis=1) < 2, len(own))
            # too few parts are left that must agree and say something
            again = empty >= parts - differ // 2
            own, b, parts, differ = own[again], b[again], parts[again], differ[again]
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def tied_sets(sets: DataFrame, rules: JoinRules) -> DataFrame:
    """``pivot, sid``: each set that shares a signature with smaller sets ids, with the least of each.

    Two sets that share a signature have its least member in common, so to compare the sets of
    each pivot with each other is to compare all sets that share a signature.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                data, offsets = text_bytes(rows.column(2))
                n = rows.column(1).to_numpy().astype(np.int64)
                sig, of = signatures(data.copy().view(U), np.diff(offsets) // 8, n, rules)
                sid = rows.column(0).to_numpy()[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(sid)], names=["sig", "sid"]
                )

    # sets too small to differ by one element and still be similar have no partner but their equal,
    # which is the same set here
    n = F.col("n").cast("long")
    signed = sets.where(n * rules.den >= (n + 1) * rules.num).mapInArrow(sign, "sig long, sid long")
    ordered = signed.repartition("sig").sortWithinPartitions("sig", "sid")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pivot = None
        for batch in batches:
            sig, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            first = sid[start].copy()
            if sig[0] == last:
                first[0] = pivot  # the run began in the batch before
            last, pivot = sig[-1], first[-1]
            least = np.repeat(first, np.diff(np.append(start, len(sig))))
            pairs = np.unique(np.stack([least, sid])[:, least != sid], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[0]), pa.array(pairs[1])], names=["pivot", "sid"]
            )

    return ordered.mapInArrow(runs, "pivot long, sid long").distinct()


def block_links(
    sids: np.ndarray, n: np.ndarray, elements: list[np.ndarray], rules: JoinRules
) -> list[tuple[int, int]]:
    """Links that connect what is similar among these sets: a tree for each component of them."""
    counts = np.array([len(x) for x in elements])
    codes, code = np.unique(np.concatenate(elements), return_inverse=True)
    owner = run_of(counts)
    shared = np.bincount(code, minlength=len(codes)) > 1
    code, owner = (np.cumsum(shared) - 1)[code[shared[code]]], owner[shared[code]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(n), len(n)))  # counts and their products stay exact below 2^53
    width = 2048
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        some = np.zeros((len(n), width), np.float32)
        some[owner[a:b], code[a:b] - lo] = 1
        common += some @ some.T
    similar = common * rules.den >= (n[:, None] + n[None, :] - common) * rules.num
    links, fresh = [], np.ones(len(n), bool)
    for i in range(len(n)):
        if not fresh[i]:
            continue
        fresh[i] = False
        todo = [i]
        while todo:
            at = todo.pop()
            near = np.flatnonzero(similar[at] & fresh)
            fresh[near] = False
            todo += near.tolist()
            links += [(int(sids[at]), int(sids[j])) for j in near]
    return links


def similar_links(tied: DataFrame, sets: DataFrame, rules: JoinRules) -> DataFrame:
    """``a, b``: links that connect all similar sets among those of each pivot.

    The sets of a pivot are compared with each other in one piece of at most ``block`` sets; a
    pivot with more has its sets dealt into blocks, and each two blocks are a piece.
    """
    whole = tied.unionByName(tied.selectExpr("pivot", "pivot AS sid").distinct())
    sizes = tied.groupBy("pivot").agg(F.ceil((F.count("*") + 1) / rules.block).alias("blocks"))
    dealt = whole.join(few(sizes, "pivots"), "pivot").withColumn(
        "own", F.pmod(F.xxhash64("sid"), F.col("blocks"))
    )
    placed = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).selectExpr(
        "pivot", "least(own, other) AS i", "greatest(own, other) AS j", "sid"
    )
    keys = ["pivot", "i", "j"]
    ordered = placed.join(sets, "sid").repartition(*keys).sortWithinPartitions(*keys, "sid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            links = []
            cells = [batch.column(k).to_numpy() for k in range(5)]
            blobs = batch.column(5)
            for r in range(batch.num_rows):
                key = tuple(c[r] for c in cells[:3])
                if key != now:
                    links += linked(held)
                    now, held = key, []
                held.append((cells[3][r], cells[4][r], np.frombuffer(blobs[r].as_buffer(), U)))
            yield _pairs(links)
        yield _pairs(linked(held))

    def linked(held: list) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        sids, n, elements = zip(*held, strict=True)
        return block_links(np.array(sids), np.array(n, np.float32), list(elements), rules)

    rows = ordered.select(*keys, "sid", "n", "elements")
    return rows.mapInArrow(compare, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root``: every node that has a link and is not the least of its component, with that
    least node. Alternates two steps that hang nodes on smaller neighbours; the links of a round
    are written, and a node with very many links is only grouped and joined on."""
    now = durable(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u != v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        sides = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        # larger neighbours of a node hang on the least node around it
        large = sides.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").selectExpr("v AS u", "m AS v").unionByName(
            least.selectExpr("u", "m AS v")
        )
        now = durable(small.distinct(), "links")
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == before:
            return now.selectExpr("u AS node", "v AS root")
        before = seen
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def similar_components(docs: DataFrame, text_col: str, rules: JoinRules) -> DataFrame:
    """``node, root``: components of the sets that are similar to another set."""
    sets = durable(shared_sets(docs, text_col, rules), "shared-sets")
    tied = durable(tied_sets(sets, rules), "tied-sets")
    return components(similar_links(tied, sets, rules))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: JoinRules | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest id reachable by links, the row's own included. Rows with equal
    shingle sets are linked; null, empty and blank texts have no shingles and are linked with
    nothing. Rows with a null id take part; their component is the smallest id that is not null.
    """
    rules = rules or JoinRules()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), rules))
            n = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
            sid = np.concatenate([np.zeros(0, U), *[f[2] for f in found]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sid.view(np.int64))],
                names=["doc_id", "n_shingles", "sid"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = durable(own.mapInArrow(read, "doc_id long, n_shingles long, sid long"), "shingle-sets")
    roots = similar_components(docs, text_col, rules)
    placed = nodes.join(roots, nodes["sid"] == roots["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "sid").alias("root")
    )
    least = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


@query("op3_jaccard_join", similar_sql(5, 75, 100))
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under the links of similar shingle sets."""
    return similar_documents(table(spark, folder, "documents").select("doc_id", "text"))
