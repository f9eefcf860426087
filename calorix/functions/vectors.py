"""Fixed-length vector columns: opening, slicing, normalising, checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calorix.schemas import RING_LAYERS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector_sum(vector) -> Column:
    """Sum of an array in double precision (0.0 for an empty array)."""
    return F.aggregate(_col(vector), F.lit(0.0), lambda s, x: s + x.cast("double"))


def open_vector(vector: str, length: int, pattern: str = "{name}_{i}", start: int = 0) -> list:
    """One column per position; positions past the end of the array are NULL.

    ``pattern`` and ``start`` cover the naming styles ``v_0``, ``v.0`` and 1-based ``v[1]``.
    """
    return [
        F.get(F.col(vector), F.lit(i)).alias(pattern.format(name=vector, i=i + start))
        for i in range(length)
    ]


def layer_slices(vector, layers=RING_LAYERS) -> dict[str, Column]:
    """Sub-array of each detector layer."""
    return {name: F.slice(_col(vector), start + 1, size) for name, start, size in layers}


def l1_norm(vector) -> Column:
    """Absolute value of the sum; a zero sum counts as 1 so that it can be divided by."""
    total = F.abs(vector_sum(vector))
    return F.when(total == 0, F.lit(1.0)).otherwise(total)


def l1_normalise(vector) -> Column:
    """Every element divided by the vector's norm, in double precision.

    The norm rides along as a one-element array, so it is computed once per row and not once
    per element.
    """
    v = _col(vector)
    scaled = F.transform(
        F.array(l1_norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)
    )
    return F.get(scaled, F.lit(0))


def all_within(vector, limit: float) -> Column:
    """True when every element lies in ``[-limit, limit]``."""
    return F.forall(_col(vector), lambda x: F.abs(x) <= F.lit(limit))
