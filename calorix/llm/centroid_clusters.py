"""Rounds of nearest-centroid clustering over compressed vectors (a VA-file).

Every component is an integer. Per dimension the values are cut into a few cells; a vector is kept
as its cell numbers, a few bits each, beside its components. For one set of centroids a table
gives, for every dimension, cell and centroid, the least and the largest squared difference that a
value of the cell can have; summed over the dimensions these bound the distance from both sides. A
centroid can only be the nearest one if its lower bound is not above the least upper bound. A
vector whose bounds leave one centroid is placed by its cells alone; the components of the others
are fetched and compared with just the centroids whose intervals overlap.

Cells only steer the work: whatever their borders, the placed centroid is the nearest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.session import collect_bounded, durable

#: Largest component: squared distances of 64 of them fit a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class ClusterRules:
    """k: centroids; rounds: of assigning and moving; size: components of a vector; scale: a component
    is floor(scale * x); bits: of a cell number; salt: prefix of the id whose hash orders the starts."""

    k: int = 40
    rounds: int = 5
    size: int = 64
    scale: int = 256
    bits: int = 6
    salt: str = "2:"

    def cells(self) -> int:
        return 1 << self.bits


def whole_vector(vector: Column, size: int | None = None) -> Column:
    """True where a vector is there, has ``size`` components, and none is null or not finite."""
    limit = F.lit(float("inf"))
    sound = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit),
    )
    fits = F.lit(True) if size is None else F.size(vector) == size
    return F.coalesce(vector.isNotNull() & fits & sound, F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of ``size`` components each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


def integers(column: pa.Array, rules: ClusterRules) -> np.ndarray:
    found = np.floor(matrix(column, rules.size).astype(np.float64) * rules.scale)
    if len(found) and np.abs(found).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // rules.scale} have no exact distance")
    return found.astype(np.int64)


def cell_borders(kept: DataFrame, rules: ClusterRules) -> tuple[np.ndarray, np.ndarray]:
    """First and last value of every cell of each dimension, from all vectors.

    Cells are equally wide up to four standard deviations around the mean; the first and the last one
    reach to the dimension's least and largest value, so outliers do not widen the others.
    """
    size = rules.size

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = integers(batch.column(0), rules)
            if not len(v):
                continue
            f = v.astype(np.float64)
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array(np.arange(size), pa.int32()),
                    "n": pa.array(np.full(size, len(v)), pa.int64()),
                    "s": pa.array(f.sum(axis=0)),
                    "q": pa.array((f * f).sum(axis=0)),
                    "lo": pa.array(v.min(axis=0)),
                    "hi": pa.array(v.max(axis=0)),
                }
            )

    parts = kept.select("vector").mapInArrow(moments, "dim int, n long, s double, q double, lo long, hi long")
    total = parts.groupBy("dim").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("lo"), F.max("hi"))
    rows = sorted(collect_bounded(total, size, "dimensions"))
    if not rows:
        return np.zeros((size, 0), np.int64), np.zeros((size, 0), np.int64)
    _, n, s, q, lo, hi = (np.array(c) for c in zip(*rows, strict=True))
    mean = s / n
    spread = np.sqrt(np.maximum(q / n - mean * mean, 0.0))
    cells = rules.cells()
    begin, end = np.maximum(lo, mean - 4 * spread), np.minimum(hi, mean + 4 * spread) + 1
    inner = begin[:, None] + ((end - begin) / cells)[:, None] * np.arange(1, cells)
    inner = np.clip(np.ceil(inner).astype(np.int64), lo[:, None], hi[:, None])
    first = np.concatenate([lo[:, None], inner], axis=1)
    last = np.concatenate([first[:, 1:] - 1, hi[:, None]], axis=1)
    return first, np.maximum(last, first)


def cell_numbers(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.searchsorted(first[d, 1:], v[:, d], "right")
    return out


def packed_cells(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers of neighbouring dimensions in one byte, as many as fit."""
    per = max(1, 8 // bits)
    wide = -(-cells.shape[1] // per) * per
    held = np.zeros((len(cells), wide), np.uint8)
    held[:, : cells.shape[1]] = cells
    out = np.zeros((len(cells), wide // per), np.uint8)
    for j in range(per):
        out |= held[:, j::per] << np.uint8(bits * j)
    return out


class Bounds:
    """Lookup tables of the least and largest squared difference of a packed byte to each centroid."""

    def __init__(self, centers: np.ndarray, first: np.ndarray, last: np.ndarray, bits: int):
        self.centers = centers
        per = max(1, 8 // bits)
        size, cells = first.shape
        low = np.maximum(first[:, :, None] - centers.T[:, None, :], 0)
        low = np.maximum(low, centers.T[:, None, :] - last[:, :, None]) ** 2
        high = np.abs(centers.T[:, None, :] - first[:, :, None])
        high = np.maximum(high, np.abs(centers.T[:, None, :] - last[:, :, None])) ** 2
        byte = np.arange(1 << (bits * per))
        groups = -(-size // per)
        self.low = np.zeros((groups, len(byte), len(centers)), np.int64)
        self.high = np.zeros_like(self.low)
        for d in range(size):
            c = (byte >> (bits * (d % per))) & (cells - 1)
            self.low[d // per] += low[d][c]
            self.high[d // per] += high[d][c]

    def nearest(self, codes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """Number of the nearest centroid of each row, the smaller of equals, and how many rows were
        fetched. ``codes`` are packed cells, ``vectors`` the components, read only where needed."""
        out = np.zeros(len(codes), np.int64)
        fetched = 0
        for at in range(0, len(codes), 1024):
            part = codes[at : at + 1024]
            low = np.zeros((len(part), len(self.centers)), np.int64)
            high = np.zeros_like(low)
            for g in range(part.shape[1]):
                low += self.low[g][part[:, g]]
                high += self.high[g][part[:, g]]
            near = low <= high.min(axis=1)[:, None]
            place = near.argmax(axis=1)
            still = np.flatnonzero(near.sum(axis=1) > 1)
            if len(still):
                fetched += len(still)
                row, center = np.nonzero(near[still])
                full = vectors[at + still].astype(np.int64)
                gap = full[row] - self.centers[center]
                d = np.einsum("ij,ij->i", gap, gap)
                order = np.lexsort((center, d, row))
                lead = np.ones(len(order), bool)
                lead[1:] = row[order][1:] != row[order][:-1]
                place[still] = center[order][lead]
            out[at : at + len(part)] = place
        return out, fetched


def vector_file(df: DataFrame, id_col: str, vector_col: str, rules: ClusterRules):
    """The written table ``id, codes, vector`` of the kept vectors and the borders of the cells."""
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kept = kept.where(whole_vector(F.col("vector"), rules.size))
    first, last = cell_borders(kept, rules)
    of_id = kept.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = integers(batch.column(1), rules)
            codes = packed_cells(cell_numbers(v, first), rules.bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rows_binary(codes), rows_binary(v.astype(np.int32))],
                names=["id", "codes", "vector"],
            )

    packed = kept.mapInArrow(pack, f"id {of_id}, codes binary, vector binary")
    return durable(packed, "vector-file"), first, last


def rows_binary(values: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    width = values.shape[1] * values.itemsize
    offsets = pa.py_buffer((np.arange(len(values) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )


def binary_rows(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """A view of a column of equally long byte strings as a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    column = column.cast(pa.binary())
    size = width * np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    begin = offsets[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + len(column) * size].view(kind).reshape(-1, width)


def starting_centers(packed: DataFrame, rules: ClusterRules) -> np.ndarray:
    """The vectors whose salted id has the smallest SHA-256, in that order; rows of one id by their
    components, rows without an id last."""
    order = F.sha2(F.concat(F.lit(rules.salt), F.col("id").cast("string")), 256)
    first = packed.select(order.alias("o"), "vector").orderBy(F.asc_nulls_last("o"), "vector").limit(rules.k)
    rows = collect_bounded(first, rules.k, "starts")
    held = [np.frombuffer(r["vector"], np.int32) for r in rows]
    return np.array(held, np.int64).reshape(len(rows), rules.size)


def moved_centers(
    packed: DataFrame, centers: np.ndarray, first: np.ndarray, last: np.ndarray, rules: ClusterRules
) -> np.ndarray:
    """One round: every vector to its nearest centroid, then floor means; sums are exact integers.

    A task adds up its own vectors, so k * (size + 1) numbers a task are shuffled.
    """
    size, k = rules.size, len(centers)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        bounds = Bounds(centers, first, last, rules.bits)
        for batch in batches:
            codes = binary_rows(batch.column(0), np.uint8, bounds.low.shape[0])
            v = binary_rows(batch.column(1), np.int32, size)
            place, _ = bounds.nearest(codes, v)
            order = np.argsort(place, kind="stable")
            held, at, n = np.unique(place[order], return_index=True, return_counts=True)
            if len(held):
                total[held, :size] += np.add.reduceat(v[order].astype(np.int64), at, axis=0)
                total[held, size] += n
        cluster, dim = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(total[cluster, dim])],
            names=["cluster", "dim", "value"],
        )

    parts = packed.select("codes", "vector").mapInArrow(sums, "cluster int, dim int, value long")
    found = parts.groupBy("cluster", "dim").agg(F.sum("value").alias("value"))
    total = [[0] * (size + 1) for _ in range(k)]
    for c, d, value in collect_bounded(found, k * (size + 1), "sums"):
        total[c][d] = value
    moved = [[x // row[size] for x in row[:size]] if row[size] else old for row, old in zip(total, centers.tolist(), strict=True)]
    return np.array(moved, np.int64)


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rules: ClusterRules | None = None
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every kept vector, and the final centroids.

    Rows whose vector is null, has another size, or holds a null or not finite component are left
    out; rows without an id and repeated rows are kept. Fewer vectors than ``k`` make as many
    centroids; no vectors make none and no rows. Components beyond 2^27 after scaling are an error.
    """
    rules = rules or ClusterRules()
    packed, first, last = vector_file(df, id_col, vector_col, rules)
    centers = starting_centers(packed, rules)
    of_id = packed.schema["id"].dataType.simpleString()
    schema = f"id {of_id}, cluster int, distance long"
    if not len(centers):
        return packed.selectExpr("id", "0 AS cluster", "0L AS distance").limit(0), centers
    for _ in range(rules.rounds):
        centers = moved_centers(packed, centers, first, last, rules)
    final = centers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(final, first, last, rules.bits)
        for batch in batches:
            codes = binary_rows(batch.column(1), np.uint8, bounds.low.shape[0])
            v = binary_rows(batch.column(2), np.int32, rules.size)
            found, _ = bounds.nearest(codes, v)
            gap = v - final[found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap), pa.int64())],
                names=["id", "cluster", "distance"],
            )

    return packed.mapInArrow(place, schema), centers


def with_inertia(placed: DataFrame, centers: np.ndarray) -> DataFrame:
    """Add the sums of distances by cluster and over all, and the digest of the row's centroid."""
    spark = placed.sparkSession
    held = durable(placed, "placed")
    sums = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    rows = collect_bounded(sums, max(1, len(centers)), "clusters")
    inertia = sum(r["cluster_inertia"] for r in rows)
    facts = [
        (
            r["cluster"],
            r["cluster_inertia"],
            inertia,
            hashlib.sha256(",".join(map(str, centers[r["cluster"]].tolist())).encode()).hexdigest(),
        )
        for r in rows
    ]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(about), "cluster")


def _round_sql(k: int) -> str:
    """Nearest centroid of every vector, then floor means; an empty cluster keeps its centroid."""
    return f"""
    near{k} AS MATERIALIZED (
        SELECT r, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT r, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM ints, center{k}) GROUP BY r, v),
    center{k + 1} AS MATERIALIZED (
        SELECT c.c, coalesce(n.m, c.m) AS m FROM center{k} c LEFT JOIN (
            SELECT c, list(m ORDER BY i) AS m FROM (
                SELECT c, i, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m
                FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM near{k}) GROUP BY c, i)
            GROUP BY c) n ON n.c = c.c)"""


SQL = f"""
WITH ints AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    center0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM ints
        ORDER BY sha256('2:' || vec_id) LIMIT 40),
{",".join(_round_sql(k) for k in range(6))}
SELECT i.vec_id, n.c::INTEGER AS cluster, n.d AS distance,
    sum(n.d) OVER (PARTITION BY n.c)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM near5 n JOIN ints i ON i.r = n.r JOIN center5 c ON c.c = n.c
"""


@query("op11_centroid_clustering", SQL)
def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after five rounds from forty hashed starts."""
    placed, centers = cluster_vectors(table(spark, folder, "embeddings"))
    return with_inertia(placed, centers).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
