"""Near duplicates by MinHash: many universal hash minima, banding, verification, components.

A document is the set of its hashed word shingles. Each of many universal hash functions keeps its
least value over the set; two sets agree in such a minimum with a chance equal to their similarity.
The minima are cut into bands; sets that agree in a whole band are candidates. Candidates are first
compared by their minima (signature), then on their full sets, which alone decide.

Equal sets are one node, whatever the number of their documents. Sets of a bucket share its least
set, the pivot, so comparing all sets of each pivot compares all sets of each bucket. A pivot with
many sets is dealt into parts; the sets of a part are compared by walking from a set to the similar
ones not reached yet, which leaves a tree of links and takes few steps where all are near copies.
What the parts link becomes one component; afterwards only sets outside the largest component of
their pivot are compared over the borders of parts, with all sets of the pivot. So no link between
components is missed and a large group of near copies costs about one comparison per member.

Components of the links come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.base import query, similar_sql, table
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

#: Numbers of sets that may be broadcast (8 MB), and parts of a hot set beyond.
BROADCAST_SETS = 1_000_000
SALTS = 16


@dataclass(frozen=True)
class MinHashRules:
    """words: of a shingle; num/den: least similarity; bands and rows: of minima; agree: least number of
    equal minima of a candidate; block: sets of a pivot that one part holds.

    With 32 bands of 4, a pair at similarity 0.8 shares no band with a chance of 5e-8, and has fewer
    than 72 of 128 equal minima with one below 1e-8; more similar pairs less often still."""

    words: int = 4
    num: int = 80
    den: int = 100
    bands: int = 32
    rows: int = 4
    agree: int = 72
    block: int = 500

    def hashes(self) -> int:
        return self.bands * self.rows


def document_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the distinct shingles of each text in order, and their number.

    A-Z are folded. A text of fewer words than a shingle is one shingle of all its words, a text
    without words has none. Shingles are 64-bit hashes.
    """
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(data[offsets[lo] : offsets[hi]], at)
        hashes = span_hashes(data[offsets[lo] : offsets[hi]], starts, ends, fold=True)
        n_words = np.diff(first)
        n = np.maximum(n_words - size + 1, 0)
        parts = [windows(hashes, size)[ranges(first[:-1], n)]]
        owners = [run_of(n)]
        for few_words in range(1, size):
            short = np.flatnonzero(n_words == few_words)
            if len(short):
                whole = np.full(len(short), U(few_words))
                for k in range(few_words):
                    whole = mix(whole * U(31) + hashes[first[:-1][short] + k])
                parts.append(whole)
                owners.append(short)
        elements, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((elements, owner))
        elements, owner = elements[order], owner[order]
        new = np.ones(len(elements), bool)
        new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        yield elements[new], np.bincount(owner[new], minlength=hi - lo)


def set_numbers(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set; 0 for the empty one."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(elements ^ U(0xD6E8FEB86659FD93)), dtype=U)])
    ends = np.cumsum(counts)
    found = mix(total[ends] - total[ends - counts] + counts.astype(U))
    return np.where(counts > 0, np.where(found == 0, U(1), found), U(0))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``n`` functions (a x + b) >> 32, a universal family on 64 bits."""
    draw = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return draw[:n] | U(1), draw[n:]


def minima(elements: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Least value of each of ``n`` functions over every set, 32 bits each; empty sets have zeros."""
    out = np.zeros((len(counts), n), np.uint32)
    held = np.flatnonzero(counts > 0)
    if len(held):
        at = (np.cumsum(counts) - counts)[held]
        for k, (a, b) in enumerate(zip(*coefficients(n), strict=True)):
            values = ((elements * a + b) >> U(32)).astype(np.uint32)
            out[held, k] = np.minimum.reduceat(values, at)
    return out


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``values`` as byte strings."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    kind, width = (pa.large_binary(), np.int64) if offsets[-1] > 2**31 - 1 else (pa.binary(), np.int32)
    made = pa.Array.from_buffers(
        kind, len(counts), [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(values.tobytes())]
    )
    return made


def signed_documents(docs: DataFrame, id_col: str, text_col: str, rules: MinHashRules) -> DataFrame:
    """The written table ``doc_id, n, sid, signature``, one row per document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_id = own.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for elements, counts in document_sets(batch.column(1), rules.words):
                signature = minima(elements, counts, rules.hashes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.array(set_numbers(elements, counts).view(np.int64)),
                        blobs(signature.ravel(), np.full(len(counts), rules.hashes())),
                    ],
                    names=["doc_id", "n", "sid", "signature"],
                )
                at += len(counts)

    return durable(own.mapInArrow(sign, f"doc_id {of_id}, n long, sid long, signature binary"), "minhash")


def whole_sets(docs: DataFrame, text_col: str, wanted: DataFrame, rules: MinHashRules) -> DataFrame:
    """The written table ``sid, signature, elements`` of the sets in ``wanted``.

    Elements take more room than text, so they are made again, for one text of each wanted set. Few
    wanted sets are broadcast; else texts meet them by set and a salt, as many can share a set.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for elements, counts in document_sets(batch.column(0), rules.words):
                sid = pa.array(set_numbers(elements, counts).view(np.int64))
                text = batch.column(0).slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([sid, text], names=["sid", "text"])
                at += len(counts)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for elements, counts in document_sets(batch.column(0), rules.words):
                signature = minima(elements, counts, rules.hashes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(set_numbers(elements, counts).view(np.int64)),
                        blobs(signature.ravel(), np.full(len(counts), rules.hashes())),
                        blobs(elements, counts),
                    ],
                    names=["sid", "signature", "elements"],
                )

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    numbered = texts.mapInArrow(number, "sid long, text string")
    held = durable(wanted, "wanted")
    if held.count() <= BROADCAST_SETS:
        met = numbered.join(F.broadcast(held), "sid", "left_semi")
    else:
        salt = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
        salted = held.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        numbered = numbered.withColumn("salt", F.pmod(salt, F.lit(SALTS)))
        met = numbered.join(salted, ["sid", "salt"], "left_semi")
    one = met.groupBy("sid").agg(F.first("text").alias("text")).select("text")
    return durable(one.mapInArrow(fill, "sid long, signature binary, elements binary"), "tied-minhash")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def tied_sets(signed: DataFrame, rules: MinHashRules) -> DataFrame:
    """``pivot, sid``: every set that shares a band with a set of a smaller number, with the smallest."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            values = matrix(batch.column(1).take(pa.array(first)), rules.hashes()).astype(U)
            key = np.zeros((len(sid), rules.bands), U) + np.arange(1, rules.bands + 1, dtype=U)
            for r in range(rules.rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + values[:, r :: rules.rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(sid, rules.bands))], names=["key", "sid"]
            )

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, pivot = None, 0
        for batch in batches:
            key, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = sid[start].copy()
            if key[0] == open_key:
                least[0] = pivot  # the bucket began in the batch before
            open_key, pivot = key[-1], least[-1]
            of = np.repeat(least, np.diff(np.append(start, len(key))))
            pairs = np.unique(np.stack([of, sid], 1)[of != sid], axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["pivot", "sid"]
            )

    keyed = signed.where("n > 0").select("sid", "signature").mapInArrow(bands, "key long, sid long")
    ordered = keyed.repartition("key").sortWithinPartitions("key", "sid")
    return durable(ordered.mapInArrow(buckets, "pivot long, sid long").distinct(), "tied")


def similar_tree(
    sids: np.ndarray, label: np.ndarray, signature: np.ndarray, elements: list[np.ndarray], rules: MinHashRules
) -> list[tuple[int, int]]:
    """Links that join what is similar among these sets; sets of one ``label`` count as joined.

    Walks from each set to the similar ones not reached yet: minima first, then whole sets.
    """
    n = np.array([len(e) for e in elements], np.int64)
    begin = np.cumsum(n) - n
    codes = np.unique(np.concatenate(elements), return_inverse=True)[1]
    marked = np.zeros(int(codes.max()) + 1, np.int64)
    fresh = np.ones(len(sids), bool)
    links = []
    for first in range(len(sids)):
        if not fresh[first]:
            continue
        fresh[first] = False
        todo = [first]
        while todo:
            at = todo.pop()
            same = np.flatnonzero(fresh & (label == label[at]))
            fresh[same] = False
            todo += same.tolist()
            near = np.flatnonzero(fresh)
            sized = (n[near] * rules.den >= n[at] * rules.num) & (n[at] * rules.den >= n[near] * rules.num)
            near = near[sized]
            near = near[(signature[near] == signature[at]).sum(axis=1) >= rules.agree]
            if not len(near):
                continue
            own = codes[begin[at] : begin[at] + n[at]]
            marked[own] = 1
            common = np.add.reduceat(marked[codes[ranges(begin[near], n[near])]], np.cumsum(n[near]) - n[near])
            marked[own] = 0
            near = near[common * rules.den >= (n[at] + n[near] - common) * rules.num]
            fresh[near] = False
            todo += near.tolist()
            links += [(int(sids[at]), int(sids[j])) for j in near]
    return links


def links_of_parts(placed: DataFrame, sets: DataFrame, rules: MinHashRules) -> DataFrame:
    """``a, b``: a tree of the similar sets of each ``pivot, i, j`` in ``placed`` (with ``sid, label``)."""
    keys = ["pivot", "i", "j"]
    rows = placed.join(sets, "sid").select(*keys, "sid", "label", "signature", "elements")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "sid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keyed = [batch.column(k).to_numpy() for k in range(5)]
            marks, sets_ = batch.column(5), batch.column(6)
            links: list = []
            for r in range(batch.num_rows):
                key = (keyed[0][r], keyed[1][r], keyed[2][r])
                if key != now:
                    links += linked(held)
                    now, held = key, []
                held.append(
                    (keyed[3][r], keyed[4][r], np.frombuffer(marks[r].as_py(), np.uint32),
                     np.frombuffer(sets_[r].as_py(), U))
                )
            yield paired(links)
        yield paired(linked(held))

    def linked(held: list) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        sids, label, marks, sets_ = zip(*held, strict=True)
        return similar_tree(np.array(sids), np.array(label), np.array(marks), list(sets_), rules)

    return ordered.mapInArrow(compare, "a long, b long")


def paired(links: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def similar_links(
    docs: DataFrame, text_col: str, signed: DataFrame, rules: MinHashRules
) -> DataFrame:
    """``a, b``: links between sets that join every component of the similarity."""
    tied = tied_sets(signed, rules)
    wanted = tied.select("sid").unionByName(tied.select(F.col("pivot").alias("sid"))).distinct()
    sets = whole_sets(docs, text_col, wanted, rules)
    parts = tied.groupBy("pivot").agg(F.count("*").alias("n"))
    parts = parts.select("pivot", F.ceil(F.col("n") / rules.block).alias("parts"))
    parts = few(parts.where("parts > 1"), "pivots")
    dealt = tied.join(parts, "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = dealt.selectExpr("pivot", "pmod(xxhash64(sid), parts) AS i", "sid")
    pivots = members.select("pivot", "i").distinct().selectExpr("pivot", "i", "pivot AS sid")
    whole = members.unionByName(pivots).selectExpr("pivot", "i", "0L AS j", "sid", "sid AS label")
    links = durable(links_of_parts(whole, sets, rules), "links")
    over = parts.limit(1).count()
    if not over:
        return links
    # pivots with several parts: sets outside the pivot's largest component, with all its sets
    root = star_components(links)
    large = tied.join(parts, "pivot").join(root.select(F.col("node").alias("sid"), "root"), "sid", "left")
    large = durable(large.selectExpr("pivot", "parts", "sid", "coalesce(root, sid) AS label"), "large-pivots")
    by_size = Window.partitionBy("pivot").orderBy(F.desc("n"), "label")
    main = large.groupBy("pivot", "label").agg(F.count("*").alias("n"))
    main = main.withColumn("k", F.row_number().over(by_size)).where("k = 1").selectExpr("pivot", "label AS main")
    rest = large.join(few(main, "main-labels"), "pivot").where("label != main").drop("main")
    rests = rest.groupBy("pivot").agg(F.ceil(F.count("*") / rules.block).alias("rests"))
    rests = few(rests, "rests")
    right = rest.join(rests, "pivot").withColumn("i", F.expr("pmod(xxhash64(sid, 1), rests)"))
    right = right.withColumn("j", F.explode(F.expr("sequence(0L, parts - 1)")))
    left = large.join(rests, "pivot").withColumn("j", F.expr("pmod(xxhash64(sid), parts)"))
    left = left.withColumn("i", F.explode(F.expr("sequence(0L, rests - 1)")))
    columns = ["pivot", "i", "j", "sid", "label"]
    across = right.select(*columns).unionByName(left.select(*columns)).distinct()
    return links.unionByName(durable(links_of_parts(across, sets, rules), "links"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join on ``key`` of rows with one row per group, of ``size`` rows, safe for hot groups.

    A group with over a thousandth of all rows is joined by broadcast (there are under a thousand
    of them); the others are shuffled.
    """
    hot = F.col(size) * 1000 > total
    heavy = F.broadcast(groups.where(hot).drop(size))
    rare = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rare.join(groups.where(~hot).drop(size), key))


def star_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: each node that has a link and is not the least of its component, with the least.

    Large-star hangs the larger neighbours of each node on the least node around it; small-star hangs
    a node and its smaller neighbours on the least of these. They alternate until nothing changes.
    Links of each step are written; a node with very many links is joined by broadcast.
    """
    edges = durable(
        links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u != v").distinct(), "star"
    )
    before = None
    for _ in range(max_rounds):
        sides = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = durable(least.selectExpr("u", "least(u, m) AS m", "n"), "star-least")
        total = 2 * edges.count()
        hung = join_groups(sides, least, "u", "n", total).where("v > u")
        edges = durable(hung.selectExpr("v AS u", "m AS v").distinct(), "star")
        # every link now names the smaller node second
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = durable(least, "star-least")
        total = edges.count()
        hung = join_groups(edges, least, "u", "n", total).where("v != m").selectExpr("v AS u", "m AS v")
        edges = durable(hung.unionByName(least.selectExpr("u", "m AS v")).distinct(), "star")
        seen = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == before:
            return edges.selectExpr("u AS node", "v AS root")
        before = seen
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: MinHashRules | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; the id keeps its type.

    ``component_id`` is the smallest id reachable by links, the row's own included. Rows with equal
    sets are linked; null, empty and blank texts have no shingles and are linked with nothing.
    Rows with a null id take part; their component is the smallest id that is not null, and they are
    kept only where it is null too. Repeated rows are each returned. Other columns are not read.
    """
    rules = rules or MinHashRules()
    signed = signed_documents(docs, id_col, text_col, rules)
    root = star_components(similar_links(docs, text_col, signed, rules))
    sets = signed.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    sets = sets.join(root.withColumnRenamed("node", "sid"), "sid", "left")
    sets = durable(sets.selectExpr("sid", "docs", "least", "coalesce(root, sid) AS root"), "sets")
    whole = sets.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    whole = durable(whole, "components")
    named = join_groups(sets.select("sid", "docs", "root"), whole, "root", "n", sets.count())
    named = durable(named.select("sid", "docs", "component_id"), "named-sets")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "sid")
    filled = rows.where("n_shingles > 0")
    found = join_groups(filled, named, "sid", "docs", signed.count())
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


_KEPT = ", d.doc_id IS NOT DISTINCT FROM CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE named.c END AS kept"


@query("op12_minhash_near_dedup", similar_sql(4, 80, 100, _KEPT))
def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under near-copy links, and whether it stays."""
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
