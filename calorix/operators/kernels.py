"""Arrow-batch kernels: distances to a few fixed centres, and lookups inside a row.

Distances to many centres are the inner loop of clustering; on whole batches they run several
times faster than element-wise SQL lambdas. A kernel measures a block of rows against one
centre; metrics without a kernel use their column expression.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _safe(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Quotient that is NaN where the denominator is zero."""
    return np.divide(num, den, out=np.full(len(num), np.nan), where=den != 0)


def _cosine(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return 1 - _safe(x @ c, np.sqrt((x * x).sum(1)) * np.sqrt(c @ c))


def _canberra(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = np.abs(x) + np.abs(c)
    return np.divide(np.abs(x - c), size, out=np.zeros_like(x), where=size != 0).sum(1)


BATCH_DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda x, c: np.sqrt(((x - c) ** 2).sum(1)),
    "sqeuclidean": lambda x, c: ((x - c) ** 2).sum(1),
    "cityblock": lambda x, c: np.abs(x - c).sum(1),
    "chebyshev": lambda x, c: np.abs(x - c).max(1),
    "cosine": _cosine,
    "correlation": lambda x, c: _cosine(x - x.mean(1, keepdims=True), c - c.mean()),
    "canberra": _canberra,
    "braycurtis": lambda x, c: _safe(np.abs(x - c).sum(1), np.abs(x + c).sum(1)),
    "hamming": lambda x, c: (x != c).mean(1),
}


def stacked(rows: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stack vectors of the expected width; others are flagged and become zeros."""
    good = np.array([r is not None and len(r) == width for r in rows], dtype=bool)
    out = np.zeros((len(rows), width))
    if good.any():
        out[good] = np.vstack(rows.to_numpy()[good])
    return out, good


def nearest(
    spark: SparkSession, centers: Sequence[Sequence[float]], metric: str
) -> Callable[[Column], Column]:
    """Column function giving ``(cluster, distance)`` of the first nearest centre.

    A missing vector, or one of another length, has neither.
    """
    shared = spark.sparkContext.broadcast(np.asarray(centers, dtype=float))
    measure = BATCH_DISTANCES[metric]

    @F.pandas_udf("cluster int, distance double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        points = shared.value
        for batch in batches:
            x, good = stacked(batch, points.shape[1])
            least = np.full(len(x), np.inf)
            cluster = np.zeros(len(x), dtype=int)
            for i, c in enumerate(points):
                d = measure(x, c)
                closer = d < least
                least[closer], cluster[closer] = d[closer], i
            known = good & np.isfinite(least)
            yield pd.DataFrame(
                {
                    "cluster": pd.Series(cluster, dtype="Int32").where(known),
                    "distance": pd.Series(least).where(known),
                }
            )

    return apply


def product_sums(vector: Column) -> Column:
    """Per batch, on its first row: count, sums and sums of products; zeros on the other rows."""

    @F.pandas_udf("array<double>")
    def sums(rows: pd.Series) -> pd.Series:
        x = np.vstack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))
        one = np.column_stack([np.ones(len(x)), x])
        total = (one.T @ one).ravel()
        return pd.Series([total if i == 0 else np.zeros_like(total) for i in range(len(rows))])

    return sums(vector)


def covariance_of(sums: np.ndarray) -> np.ndarray:
    """Sample covariance from the added-up sums of :func:`product_sums`."""
    d = round(len(sums) ** 0.5)
    m = sums.reshape(d, d)
    n, total = m[0, 0], m[0, 1:]
    return (m[1:, 1:] - np.outer(total, total) / n) / max(n - 1, 1)


def inverse(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.inv(matrix)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column, their row and their place in it; nulls inside are left out.

    The values of a list of lists stand at the place of their inner list.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = lists.flatten()
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        inner = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        row, place, values = np.repeat(row, inner), np.repeat(place, inner), values.flatten()
    known = values.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(values, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return np.where(known, values, 0), np.where(known, row, -1), place


def positions_of(wanted: pa.Array, keys: pa.Array, last: bool) -> pa.Array:
    """For each wanted value the last (or first) place in the same row's ``keys``, else null.

    Rows are events; ``keys`` may be a list of lists, whose values stand at their list's place.
    """
    key, key_row, place = _flat(keys)
    value, row, _ = _flat(wanted)
    key, place, key_row = key[key_row >= 0], place[key_row >= 0], key_row[key_row >= 0]
    codes, code = np.unique(np.concatenate([key, value]), return_inverse=True)
    n = max(1, len(codes))
    held = key_row * n + code[: len(key)]
    asked = row * n + code[len(key) :]
    order = np.lexsort((place, held))
    held, place = held[order], place[order]
    at = np.searchsorted(held, asked, "right") - 1 if last else np.searchsorted(held, asked)
    inside = (at >= 0) & (at < len(held)) & (row >= 0)
    at = np.where(inside, at, 0)
    found = inside & (held[at] == asked) if len(held) else np.zeros(len(asked), bool)
    sizes = pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    positions = place[at] if len(held) else np.zeros(len(asked), np.int64)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(positions, pa.int32(), mask=~found)
    )


def position_lookup(last: bool) -> Callable[[Column, Column], Column]:
    """Column function for :func:`positions_of`."""

    def find(wanted: pa.Array, keys: pa.Array) -> pa.Array:
        return positions_of(wanted, keys, last)

    return F.arrow_udf(find, "array<int>")


# Workers need the helpers above even where the package itself is not installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
