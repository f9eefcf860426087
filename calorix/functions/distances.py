"""Distances from a vector column to a fixed centre, by metric name.

Every builder returns a plain column expression, so the caller can combine the distances to
many centres in one projection. Boolean metrics look at whether elements are non-zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from calorix.functions.physics import ratio

Center = Sequence[float]
DistanceBuilder = Callable[[Column, Center], Column]

CUSTOM_DISTANCES: dict[str, DistanceBuilder] = {}


def _lit(values: Center) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _fold(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _pairwise(v: Column, center: Center, term: Callable[[Column, Column], Column]) -> Column:
    return _fold(F.zip_with(v, _lit(center), lambda x, c: term(x.cast("double"), c)))


def _sqeuclidean(v, c):
    return _pairwise(v, c, lambda x, y: (x - y) * (x - y))


def _cosine(v, c):
    norm = math.sqrt(sum(x * x for x in c))
    own = F.sqrt(_fold(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return 1 - ratio(_pairwise(v, c, lambda x, y: x * y), own * F.lit(norm))


def _centered(v: Column) -> Column:
    mean = F.array(_fold(F.transform(v, lambda x: x.cast("double"))) / F.size(v))
    return F.get(
        F.transform(mean, lambda m: F.transform(v, lambda x: x.cast("double") - m)), F.lit(0)
    )


def _correlation(v, c):
    mean = sum(c) / len(c)
    return _cosine(_centered(v), [x - mean for x in c])


def _canberra(v, c):
    def term(x, y):
        size = F.abs(x) + F.abs(y)
        return F.when(size == 0, F.lit(0.0)).otherwise(F.abs(x - y) / size)

    return _pairwise(v, c, term)


def _braycurtis(v, c):
    return ratio(
        _pairwise(v, c, lambda x, y: F.abs(x - y)), _pairwise(v, c, lambda x, y: F.abs(x + y))
    )


def _chebyshev(v, c):
    return F.array_max(F.zip_with(v, _lit(c), lambda x, y: F.abs(x.cast("double") - y)))


def _one_if(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def _hamming(v, c):
    return _pairwise(v, c, lambda x, y: _one_if(x != y)) / F.size(v)


def _jaccard(v, c):
    return ratio(
        _pairwise(v, c, lambda x, y: _one_if((x != y) & ((x != 0) | (y != 0)))),
        _pairwise(v, c, lambda x, y: _one_if((x != 0) | (y != 0))),
    )


def _divergence(x: Column, m: Column) -> Column:
    return (
        F.when(x > 0, x * F.log(x / m))
        .when(x == 0, F.lit(0.0))
        .otherwise(F.lit(float("inf")))
    )


def _jensenshannon(v, c):
    total = sum(c)
    own = F.array(_fold(F.transform(v, lambda x: x.cast("double"))))
    p = F.get(F.transform(own, lambda s: F.transform(v, lambda x: ratio(x, s))), F.lit(0))

    def term(x, y):
        m = (x + y) / 2
        return _divergence(x, m) + _divergence(y, m)

    return F.sqrt(_pairwise(p, [x / total for x in c], term) / 2)


def _truth_table(v: Column, c: Center) -> tuple[Column, Column, Column, Column]:
    """Counts of positions that are non-zero in both, only the row, only the centre, neither.

    Two sums over the row are enough: the centre's own count is known beforehand.
    """
    n, center_set = float(len(c)), float(sum(1 for x in c if x != 0))
    row_set = _fold(F.transform(v, lambda x: _one_if(x != 0)))
    both = _pairwise(v, [1.0 if x != 0 else 0.0 for x in c], lambda x, y: _one_if(x != 0) * y)
    return both, row_set - both, center_set - both, n - row_set - center_set + both


def _boolean(formula: Callable[..., Column]) -> DistanceBuilder:
    return lambda v, c: formula(*_truth_table(v, c))


def _yule(tt, tf, ft, ff):
    cross = tf * ft
    return F.when(cross == 0, F.lit(0.0)).otherwise(2 * cross / (tt * ff + cross))


def minkowski(p: float = 2.0) -> DistanceBuilder:
    return lambda v, c: F.pow(
        _pairwise(v, c, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p)
    )


def seuclidean(variances: Sequence[float]) -> DistanceBuilder:
    """Euclidean distance with each position divided by its variance."""

    def build(v, c):
        terms = F.zip_with(v, _lit(c), lambda x, y: F.pow(x.cast("double") - y, 2))
        return F.sqrt(_fold(F.zip_with(terms, _lit(variances), lambda t, s: t / s)))

    return build


def mahalanobis(inverse_covariance: Sequence[Sequence[float]]) -> DistanceBuilder:
    """``sqrt(d' M d)`` for a fixed inverse covariance matrix ``M``."""

    def build(v, c):
        gap = F.zip_with(v, _lit(c), lambda x, y: x.cast("double") - y)
        rows = F.array(*[_lit(row) for row in inverse_covariance])
        projected = F.transform(rows, lambda row: _fold(F.zip_with(gap, row, lambda a, b: a * b)))
        return F.sqrt(_fold(F.zip_with(projected, gap, lambda a, b: a * b)))

    return build


DISTANCES: dict[str, DistanceBuilder] = {
    "braycurtis": _braycurtis,
    "canberra": _canberra,
    "chebyshev": _chebyshev,
    "cityblock": lambda v, c: _pairwise(v, c, lambda x, y: F.abs(x - y)),
    "correlation": _correlation,
    "cosine": _cosine,
    "dice": _boolean(lambda tt, tf, ft, ff: ratio(tf + ft, 2 * tt + tf + ft)),
    "euclidean": lambda v, c: F.sqrt(_sqeuclidean(v, c)),
    "hamming": _hamming,
    "jaccard": _jaccard,
    "jensenshannon": _jensenshannon,
    "kulczynski1": _boolean(lambda tt, tf, ft, ff: ratio(tt, tf + ft)),
    "matching": _hamming,
    "minkowski": minkowski(),
    "rogerstanimoto": _boolean(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))),
    "russellrao": _boolean(lambda tt, tf, ft, ff: (tf + ft + ff) / (tt + tf + ft + ff)),
    "sokalmichener": _boolean(lambda tt, tf, ft, ff: 2 * (tf + ft) / (tt + ff + 2 * (tf + ft))),
    "sokalsneath": _boolean(lambda tt, tf, ft, ff: ratio(2 * (tf + ft), tt + 2 * (tf + ft))),
    "sqeuclidean": _sqeuclidean,
    "yule": _boolean(_yule),
}
# Metrics that need a fitted parameter: build them with the factory of the same name.
PARAMETRIC = {"minkowski": minkowski, "seuclidean": seuclidean, "mahalanobis": mahalanobis}


def register_distance(name: str, builder: DistanceBuilder) -> None:
    """Make a custom metric available by name."""
    CUSTOM_DISTANCES[name] = builder


def distance(
    vector, center: Center, metric: str | DistanceBuilder = "euclidean", **params
) -> Column:
    """Distance from ``vector`` to ``center`` by metric name, custom name or builder."""
    v = F.col(vector) if isinstance(vector, str) else vector
    if callable(metric):
        return metric(v, center)
    if params or (metric in PARAMETRIC and metric not in DISTANCES):
        return PARAMETRIC[metric](**params)(v, center)
    builder = CUSTOM_DISTANCES.get(metric) or DISTANCES.get(metric)
    if builder is None:
        raise ValueError(f"unknown distance: {metric}")
    return builder(v, center)
