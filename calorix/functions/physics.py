"""Scalar physics and score expressions as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from calorix.functions.vectors import vector_sum
from calorix.schemas import ENERGY_SAMPLE_INDEX

MISSING_RATIO = -1.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """``num / den``; a zero denominator gives ``otherwise`` (NULL by default)."""
    out = F.when(den != 0, num / den)
    return out if otherwise is None else out.when(den == 0, F.lit(otherwise))


def greater(a: Column, b: Column) -> Column:
    """``a > b`` that is false for NaN; Spark orders NaN above every number."""
    return (a > b) & ~F.isnan(a)


def delta_r(eta1, phi1, eta2, phi2) -> Column:
    """Distance in the eta-phi plane; an azimuth gap of pi or more goes the other way round."""
    deta = F.abs(col(eta1) - col(eta2))
    dphi = F.abs(col(phi1) - col(phi2))
    dphi = F.when(dphi >= math.pi, 2 * math.pi - dphi).otherwise(dphi)
    return F.sqrt(deta * deta + dphi * dphi)


def trigger_delta_phi(l1_phi, l2_phi) -> Column:
    """Azimuth gap between trigger levels; first-level angles above pi are shifted by 2 pi."""
    l1, l2 = col(l1_phi), col(l2_phi)
    gap = F.abs(l2 - F.when(F.abs(l1) > math.pi, l1 - 2 * math.pi).otherwise(l1))
    return F.when(gap > math.pi, 2 * math.pi - gap).otherwise(gap)


def in_box(eta, phi, center_eta, center_phi, deta, dphi) -> Column:
    """True when the point lies strictly inside the cluster's eta-phi box."""
    return (F.abs(col(eta) - col(center_eta)) < col(deta)) & (
        F.abs(col(phi) - col(center_phi)) < col(dphi)
    )


def eta_phi_range(eta, phi, deta, dphi) -> tuple[Column, Column]:
    """Lower and upper edge of a cluster in eta and in phi, as two structs."""

    def span(center, half):
        return F.struct(
            (col(center) - col(half)).alias("low"), (col(center) + col(half)).alias("high")
        )

    return span(eta, deta), span(phi, dphi)


def in_crack(abs_eta) -> Column:
    """Barrel-endcap transition and the outer edge, where shower shapes are not trusted."""
    e = col(abs_eta)
    return greater(e, F.lit(2.37)) | ((e > 1.37) & (e < 1.52))


def _sample(energies: Column, *names: str) -> Column:
    parts = [F.get(energies, F.lit(ENERGY_SAMPLE_INDEX[n])).cast("double") for n in names]
    return sum(parts[1:], parts[0])


def first_layer_fraction(energies) -> Column:
    """Share of the energy in the first sampling; -1 when the total is practically zero."""
    e = col(energies)
    # the total sits in a one-element array, so that it is summed once per row
    share = F.transform(
        F.array(vector_sum(e)),
        lambda total: F.when(F.abs(total) > 1e-5, _sample(e, "EMB1", "EME1") / total).otherwise(
            F.lit(MISSING_RATIO)
        ),
    )
    return F.get(share, F.lit(0))


def third_layer_fraction(energies) -> Column:
    """Share of the energy in the third sampling of the four electromagnetic ones."""
    e = col(energies)
    layers = [
        _sample(e, "PreSamplerB", "PreSamplerE"),
        _sample(e, "EMB1", "EME1"),
        _sample(e, "EMB2", "EME2"),
        _sample(e, "EMB3", "EME3"),
    ]
    total = layers[0] + layers[1] + layers[2] + layers[3]
    return F.when(F.abs(total) > 0, layers[3] / total).otherwise(F.lit(0.0))


def peak_ratio(first, second) -> Column:
    """Contrast of the two highest cells of the first sampling; -1 when they sum to zero."""
    a, b = col(first).cast("double"), col(second).cast("double")
    return ratio(a - b, a + b, MISSING_RATIO)


def core_ratio(e237, e277) -> Column:
    return ratio(col(e237).cast("double"), col(e277).cast("double"), MISSING_RATIO)


def hadronic_et(et, e277, abs_eta) -> Column:
    return (col(et).cast("double") - col(e277).cast("double")) / F.cosh(col(abs_eta))


def sp_index(tpr, fpr) -> Column:
    """Geometric and arithmetic mean of efficiency and rejection, combined."""
    t, r = col(tpr), 1 - col(fpr)
    return F.sqrt(F.sqrt(t * r) * ((t + r) / 2))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def decide(proba, threshold: float) -> Column:
    """Label 1 when the probability reaches the threshold, else 0."""
    return F.when(col(proba) >= threshold, 1).otherwise(0)


def standard_score(value, mean, std) -> Column:
    """``(value - mean) / std``; a constant column (zero spread) gives NULL."""
    return ratio(col(value) - col(mean), col(std))


def between(value, low, high, inclusive: str = "both") -> Column:
    """Interval test with either, both or neither bound included."""
    v, lo, hi = col(value), low, high
    if inclusive not in ("both", "neither", "left", "right"):
        raise ValueError(f"unknown inclusive mode: {inclusive}")
    above = v >= lo if inclusive in ("both", "left") else v > lo
    below = v <= hi if inclusive in ("both", "right") else v < hi
    return above & below


def linear_score(vector, coef, bias: float) -> Column:
    """Dot product with fixed coefficients plus a bias; NULL when the lengths differ."""
    v = col(vector)
    weights = F.array(*[F.lit(float(c)) for c in coef])
    dot = F.aggregate(
        F.zip_with(v, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x
    )
    return F.when(F.size(v) == len(coef), dot + F.lit(float(bias)))
