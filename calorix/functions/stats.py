"""Tail probabilities as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples up to this size have an exact distribution of the rank sum.
EXACT_LIMIT = 50


def two_sided_normal(z: Column) -> Column:
    """Probability of a standard normal deviate at least as far from zero as ``z``.

    Near zero by the series of the error function, whose terms are all positive, beyond by its
    continued fraction, so small probabilities keep their digits.
    """
    x = F.abs(z) / math.sqrt(2)
    first = F.struct(x.alias("term"), x.alias("sum"))

    def longer(s: Column, k: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), first, longer)["sum"]
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), F.lit(0.0), lambda f, k: k / 2 / (x + f))
    far = F.exp(-x * x) / math.sqrt(math.pi) / (x + fraction)
    return F.when(x < 2, near).otherwise(far)


def two_sided_rank_sum(n: Column, statistic: Column) -> Column:
    """Probability of a signed-rank sum at least as far from its mean as the smaller sum ``statistic``,
    for ``n`` different ranks with random signs; NULL for ``n`` over the limit.

    The number of sign patterns with each sum grows rank by rank: rank k adds the counts of k
    places below. Counts stay below 2^50 and are exact.
    """
    size = F.least(n, F.lit(EXACT_LIMIT)).cast("int")
    top = (size * (size + 1) / 2).cast("int")
    none = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def with_rank(counts: Column, k: Column) -> Column:
        return F.transform(counts, lambda c, i: c + F.when(i >= k, F.get(counts, (i - k).cast("int"))).otherwise(0.0))

    counts = F.aggregate(F.sequence(F.lit(1), size), none, with_rank)
    low = F.aggregate(F.slice(counts, 1, F.floor(statistic).cast("int") + 1), F.lit(0.0), lambda s, c: s + c)
    exact = F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), size))
    return F.when((n > 0) & (n <= EXACT_LIMIT), exact)
