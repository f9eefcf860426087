"""p-values of the signed-rank test against enumeration and the error function."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from calorix.functions.stats import two_sided_normal, two_sided_rank_sum
from calorix.operators.compare import wilcoxon


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11])
def test_rank_sums_are_those_of_all_sign_patterns(spark, n):
    sums = [sum(k for k, plus in enumerate(p, 1) if plus) for p in itertools.product((0, 1), repeat=n)]
    top = n * (n + 1) // 2
    df = spark.range(0, top // 2 + 1).select(F.col("id").alias("w"))
    found = df.select("w", two_sided_rank_sum(F.lit(n), F.col("w").cast("double")).alias("p")).collect()
    for w, p in found:
        assert p == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))


def test_large_samples_have_no_exact_sum(spark):
    assert spark.range(1).select(two_sided_rank_sum(F.lit(51), F.lit(3.0))).first()[0] is None
    half = spark.range(1).select(two_sided_rank_sum(F.lit(50), F.lit(637.0))).first()[0]
    assert half == pytest.approx(1.0, abs=0.01)


def test_normal_tails_keep_their_digits(spark):
    zs = [0.0, 0.1, 1.0, -1.96, 2.8, 2.9, 5.0, -8.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p in df.select("z", two_sided_normal(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)


def test_published_example_and_choice_of_distribution(spark):
    # differences 1..9 with ranks 1, 2, 3, 4 negative: W = 10
    rows = [(float(k), 0.0) if k > 4 else (0.0, float(k)) for k in range(1, 10)]
    out = wilcoxon(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (out["n"], out["statistic"]) == (9, 10.0)
    assert out["p_value"] == pytest.approx(0.1640625)
    tied = wilcoxon(spark.createDataFrame([*rows, (9.0, 0.0)], "x double, y double"), "x", "y").first()
    assert tied["p_value"] == pytest.approx(math.erfc(abs(tied["z"]) / math.sqrt(2)))
    zero = wilcoxon(spark.createDataFrame([*rows, (1.0, 1.0)], "x double, y double"), "x", "y").first()
    assert zero["n"] == 9 and zero["p_value"] == pytest.approx(math.erfc(abs(zero["z"]) / math.sqrt(2)))
    none = wilcoxon(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y").first()
    assert none["n"] == 0 and none["p_value"] is None
