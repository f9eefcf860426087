"""Distributions, aggregates and run comparison against direct computation."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calorix.operators import compare as co
from calorix.operators import profile as pr
from tests.conftest import rows


def test_histogram_matches_numpy(spark):
    rng = random.Random(1)
    data = [round(rng.gauss(0, 1), 2) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    edges = pr.linear_edges(min(data), max(data), 20)
    counts, _ = np.histogram(data, bins=edges)
    found = {r["bin"]: r["n"] for r in pr.histogram(df, "x", nbins=20).collect()}
    assert found == {i: n for i, n in enumerate(counts) if n}
    density = pr.histogram(df, "x", nbins=20)
    area = density.agg(F.sum(F.col("density") * (F.col("bin_high") - F.col("bin_low")))).first()[0]
    assert area == pytest.approx(1.0)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["n"] for r in pr.histogram(df, "x").collect()] == [2]


def test_histogram2d_marginals(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0), (1.0, 1.0), (5.0, 0.0)], "x double, y double")
    out = pr.histogram2d(df, "x", "y", [0.0, 0.5, 1.0], [0.0, 0.5, 1.0])
    assert rows(out.select("x_bin", "y_bin", "n", "n_x", "n_y")) == [
        (0, 0, 1, 1, 1),
        (1, 1, 2, 2, 2),
    ]


def test_event_top2_counts_copies(spark):
    data = [(1, 5.0, 0.1, 3.0, 1)] * 3 + [(1, 4.0, 0.2, -3.0, 2), (2, 7.0, 0.0, 0.0, 3)]
    df = spark.createDataFrame(data, "ev int, e double, eta double, phi double, id int")
    out = pr.event_top2(df, "ev", "e", "eta", "phi", "id", []).orderBy("ev").collect()
    assert out[0]["n_objects"] == 4 and out[0]["n_duplicates"] == 3
    assert (out[0]["highest_e1"], out[0]["highest_e2"], out[0]["delta_r"]) == (5.0, 5.0, 0.0)
    assert out[1]["highest_e2"] is None and out[1]["delta_r"] is None


def test_weighted_spread(spark):
    v, w = np.array([1.0, 2.0, 5.0, 9.0]), np.array([1.0, 2.0, 0.0, 3.0])
    df = spark.createDataFrame(list(zip(v.tolist(), w.tolist())), "v double, w double")
    mean = (v * w).sum() / w.sum()
    spread = math.sqrt((w * (v - mean) ** 2).sum() / (2 * w.sum() / 3))
    out = pr.weighted_stats(df, "v", "w").first()
    assert tuple(out) == pytest.approx((mean, spread, 3))


def test_vector_profile(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],)], "v array<float>")
    out = pr.vector_profile(df, "v", normalise=True, layers=(("A", 0, 1), ("B", 1, 1)))
    assert rows(out.select("position", "mean", "std", "layer")) == [
        (0, 0.125, 0.125, "A"),
        (1, 0.375, 0.375, "B"),
    ]


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    same = df.orderBy(F.desc("id"))
    other = df.withColumn("x", F.when(F.col("id") == 5, 99).otherwise(F.col("x")))
    assert pr.frame_digest(df).first() == pr.frame_digest(same).first()
    assert pr.frame_digest(df).first() != pr.frame_digest(other).first()


def test_digest_sums_pass_the_range_of_a_long(spark):
    # 2**33 copies of one row, summed in a few tasks by the expression the digest uses
    words = [r for r in pr.frame_digest(spark.range(4)).first()[1:]]
    assert all(isinstance(w, str) and int(w) < 2**34 for w in words)
    big = spark.range(10).select(F.lit("9" * 27).cast("decimal(28,0)").alias("x"))
    assert int(big.agg(F.sum("x").cast("string")).first()[0]) == 10 * int("9" * 27) > 2**63


def test_energy_ratio_with_repeated_ids(spark):
    """Clusters, seeds and particles listed several times, as in united inputs, against SQL."""
    draw = random.Random(8)
    at = lambda: (draw.uniform(-2, 2), draw.uniform(-3, 3))
    c = [
        (draw.choice([None, *range(12)]), draw.choice([None, *range(6)]), draw.random() + 1, draw.random() + 1, *at(), 0.9, 1.4)
        for _ in range(40)
    ]
    s = [(draw.randrange(5),) for _ in range(9)] + [(None,)]
    p = [(draw.randrange(15), draw.randrange(7), draw.random(), draw.random(), *at()) for _ in range(90)]
    names = {
        "c": ["id", "seed_id", "e", "et", "eta", "phi", "deta", "dphi"],
        "s": ["id"],
        "p": ["id", "seed_id", "e", "et", "eta", "phi"],
    }
    types = {"id": "long", "seed_id": "long"}
    duck, frames = duckdb.connect(), {}
    for name, data in (("c", c), ("s", s), ("p", p)):
        schema = ", ".join(f"{n} {types.get(n, 'double')}" for n in names[name])
        frames[name] = spark.createDataFrame(data, schema)
        frame = pd.DataFrame(data, columns=names[name])
        frame = frame.astype({k: "Int64" for k in names[name] if k in types})
        duck.register(name, frame)
    expected = duck.execute(
        """SELECT c.id, count(DISTINCT c.id), max(c.et), max(c.e), count(DISTINCT s.id),
                  count(DISTINCT p.id),
                  count(*) FILTER (abs(p.eta - c.eta) < c.deta AND abs(p.phi - c.phi) < c.dphi),
                  sum(p.et) * 1000, sum(p.et) * 1000 / max(c.et), sum(p.e) * 1000,
                  sum(p.e) * 1000 / max(c.e)
           FROM c JOIN s ON c.seed_id = s.id JOIN p ON s.id = p.seed_id
           GROUP BY c.id HAVING count(DISTINCT c.id) = 1 ORDER BY c.id"""
    ).fetchall()
    found = pr.energy_ratio(frames["c"], frames["s"], frames["p"], cell=2.9).orderBy("cluster_id")
    assert [tuple(r) for r in found.collect()] == [pytest.approx(r) for r in expected]


def test_energy_ratio_with_a_hot_seed(spark):
    """A seed with a third of the particles and of the clusters, against all pairs."""
    rng = random.Random(4)
    clusters = [
        (i, 0 if i % 3 == 0 else i, 10.0 + i, 20.0, rng.uniform(-2, 2), rng.uniform(-3, 3),
         rng.choice([0.1, 0.3]), 0.4)
        for i in range(90)
    ]
    particles = [
        (i, 0 if i % 3 == 0 else i % 90, rng.random(), rng.random(), rng.uniform(-2, 2),
         rng.uniform(-3, 3))
        for i in range(600)
    ]
    c = spark.createDataFrame(
        clusters,
        "id int, seed_id int, e double, et double, eta double, phi double, deta double, dphi double",
    )
    p = spark.createDataFrame(
        particles, "id int, seed_id int, e double, et double, eta double, phi double"
    )
    seeds = spark.range(90)
    found = {r["cluster_id"]: r for r in pr.energy_ratio(c, seeds, p).collect()}
    for cid, seed, e, et, eta, phi, deta, dphi in clusters:
        own = [x for x in particles if x[1] == seed]
        if not own:
            assert cid not in found
            continue
        r = found[cid]
        assert r["n_particles"] == len(own)
        assert r["in_cluster"] == sum(
            abs(x[4] - eta) < deta and abs(x[5] - phi) < dphi for x in own
        )
        assert r["total_tp_et"] == pytest.approx(1000 * sum(x[3] for x in own))
        assert r["total_tp_energy_cl_e_ratio"] == pytest.approx(1000 * sum(x[2] for x in own) / e)


def test_exact_quantiles_with_a_hot_group(spark):
    rng = random.Random(2)
    data = [("hot", float(rng.randrange(50))) for _ in range(500)]
    data += [(f"g{i % 7}", rng.random()) for i in range(100)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    for r in co.exact_quantiles(df, ["g"], "x", points).collect():
        own = [x for g, x in data if g == r["g"]]
        assert tuple(r)[1:] == pytest.approx(tuple(np.percentile(own, [25, 50, 75])))


def test_best_per_group_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, None)], "g string, id int, m double")
    assert rows(co.best_per_group(df, ["g"], "m", ["id"])) == [("a", 1, 5.0), ("b", 3, None)]
    with pytest.raises(ValueError):
        co.best_run(df, "m", ["id"], mode="median")


def test_wilcoxon_small_example(spark):
    x = [125, 115, 130, 140, 140, 115, 140, 125, 140, 135]
    y = [110, 122, 125, 120, 140, 124, 123, 137, 135, 145]
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    out = co.wilcoxon(df, "x", "y").first()
    assert (out["n"], out["w_plus"], out["w_minus"], out["statistic"]) == (9, 27.0, 18.0, 18.0)
    assert co.normal_p_value(out["z"]) == pytest.approx(0.5936, abs=2e-3)


def test_wilcoxon_without_differences(spark):
    df = spark.createDataFrame([(1, 1)], "x int, y int")
    out = co.wilcoxon(df, "x", "y").first()
    assert out["n"] == 0 and out["z"] is None


def test_describe_folds(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "fold int, m double")
    found = {(r["fold"], r["metric"]): r["value"] for r in co.describe_folds(df, "fold", ["m"]).collect()}
    assert found[(0, "m.mean")] == 2.0 and found[(0, "m.median")] == 2.0
    assert found[(1, "m.std")] is None and len(found) == 10


def test_cutoff_keeps_the_first_above_the_limit(spark):
    df = spark.createDataFrame([(0, 6.0), (1, 3.0), (2, 1.0)], "i int, v double")
    out = co.cumulative_cutoff(df, ["i"], "v", 0.8).orderBy("i").collect()
    assert [r["kept"] for r in out] == [True, True, False]


def test_metric_diff_starts_infinite(spark):
    df = spark.createDataFrame([(2, 5.0), (1, 9.0), (3, 4.5)], "k int, m double")
    out = co.metric_diff(df, "k", ["m"]).orderBy("k").collect()
    assert [r["m_diff"] for r in out] == [float("inf"), -4.0, -0.5]


def test_categories(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert Counter(dict(rows(pr.category_counts(df, "c").select("c", "n")))) == {"a": 2, "b": 1}
