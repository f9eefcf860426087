"""Distances, clustering, scoring and training."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from calorix.functions import distances as di
from calorix.operators import clusters as cl
from calorix.operators import scoring as sc
from calorix.operators.training import replicated, train_folds
from tests.conftest import rows

X = np.array([1.0, 0.0, 2.0, 0.0, 4.0])
C = np.array([0.0, 0.0, 3.0, 1.0, 1.0])


def js(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def kl(a):
        return sum(x * math.log(x / y) for x, y in zip(a, m) if x > 0)

    return math.sqrt((kl(p) + kl(q)) / 2)


EXPECTED = {
    "euclidean": math.sqrt(12),
    "sqeuclidean": 12.0,
    "cityblock": 6.0,
    "chebyshev": 3.0,
    "cosine": 1 - 10 / math.sqrt(21 * 11),
    "correlation": 1 - np.corrcoef(X, C)[0, 1],
    "canberra": 1 + 0 + 1 / 5 + 1 + 3 / 5,
    "braycurtis": 6 / 12,
    "hamming": 4 / 5,
    "matching": 4 / 5,
    "jensenshannon": js(X, C),
    "minkowski": math.sqrt(12),
    # non-zero in both 2, only left 1, only right 1, neither 1
    "dice": 2 / 6,
    "jaccard": 4 / 4,
    "kulczynski1": 2 / 2,
    "rogerstanimoto": 4 / 7,
    "russellrao": 3 / 5,
    "sokalmichener": 4 / 7,
    "sokalsneath": 4 / 6,
    "yule": 2 * 1 / (2 * 1 + 1),
}


def measure(spark, **columns):
    return spark.createDataFrame([(X.tolist(),)], "v array<float>").select(
        *[c.alias(n) for n, c in columns.items()]
    ).first()


def test_named_distances(spark):
    assert set(EXPECTED) == set(di.DISTANCES)
    found = measure(spark, **{n: di.distance("v", C.tolist(), n) for n in EXPECTED})
    for name, value in EXPECTED.items():
        assert found[name] == pytest.approx(value), name


def test_parametric_and_custom_distances(spark):
    variances = [1.0, 2.0, 3.0, 4.0, 5.0]
    inverse = np.diag([1.0, 2.0, 1.0, 1.0, 0.5])
    inverse[0, 2] = inverse[2, 0] = 0.25
    gap = X - C
    di.register_distance("first_gap", lambda v, c: F.abs(F.get(v, F.lit(0)) - c[0]))
    found = measure(
        spark,
        p3=di.distance("v", C.tolist(), "minkowski", p=3),
        se=di.distance("v", C.tolist(), "seuclidean", variances=variances),
        ma=di.distance("v", C.tolist(), "mahalanobis", inverse_covariance=inverse.tolist()),
        own=di.distance("v", C.tolist(), "first_gap"),
    )
    assert found["p3"] == pytest.approx((np.abs(gap) ** 3).sum() ** (1 / 3))
    assert found["se"] == pytest.approx(math.sqrt((gap**2 / variances).sum()))
    assert found["ma"] == pytest.approx(math.sqrt(gap @ inverse @ gap))
    assert found["own"] == 1.0
    with pytest.raises(ValueError):
        di.distance("v", C.tolist(), "unknown")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    data = [
        (i, (rng.normal(0, 0.2, 2) + 5 * np.array([i % 3, (i % 3) ** 2])).tolist(), i % 3)
        for i in range(90)
    ]
    return spark.createDataFrame(data, "id int, v array<double>, y int")


@pytest.mark.parametrize("init", ["farthest_point", "proportional"])
@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_lloyd_finds_separate_groups(blobs, init, metric):
    model = cl.MetricKMeans(k=3, init=init, n_init=2, metric=metric, seed=1).fit(blobs, "v", "id")
    placed = model.predict(blobs, "v")
    assert placed.groupBy("y").agg(F.count_distinct("cluster").alias("n")).agg(
        F.max("n")
    ).first()[0] == 1
    assert model.inertia == min(model.inertia_inits)


def test_ties_go_to_the_first_centre(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    assert cl.nearest_center(df, "v", [[0.0], [2.0]]).first()["cluster"] == 0


def test_evaluation(blobs):
    placed = cl.nearest_center(blobs, "v", [[0.0, 0.0], [5.0, 5.0]], "sqeuclidean")
    counts = cl.cluster_class_counts(placed, "cluster", "y", "distance")
    out = {r["cluster"]: r for r in cl.cluster_evaluation(counts, [0, 1, 2]).collect()}
    assert out[0]["n_samples"] == 30 and out[0]["class_"] == 0
    # both classes are complete in cluster 1: the smaller class wins
    assert out[1]["n_samples"] == 60 and out[1]["class_"] == 1 and out[1]["class_2_ratio"] == 100.0
    compat = cl.cluster_evaluation(counts, [0, 1, 2], compat=True)
    total = sum(r["inertia"] for r in out.values())
    assert {r["cluster"]: r["variance"] for r in compat.collect()} == pytest.approx(
        {0: total / 30, 1: total / 60}
    )
    per_class = {r["label"]: r for r in cl.class_evaluation(counts).collect()}
    assert (per_class[2]["tp"], per_class[2]["fn"], per_class[2]["tpr"]) == (0, 30, 0.0)
    assert (per_class[1]["fp"], per_class[1]["tn"]) == (30, 30)
    assert cl.clustering_accuracy(counts).first()["accuracy"] == pytest.approx(2 / 3)


def test_single_cluster_has_no_score(blobs):
    one = blobs.withColumn("cluster", F.lit(0))
    assert cl.calinski_harabasz(one, "v").first()["calinski_harabasz_score"] == -1e6


def test_reduction_whitens(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 2))
    data = np.c_[base, base @ [[1.0], [2.0]] + 1e-9, 5 + rng.normal(size=(200, 1))]
    df = spark.createDataFrame([(x.tolist(),) for x in data], "v array<double>")
    reduced = cl.fit_reduction(df, "v")
    assert reduced.n_components == 3
    white = np.array([r[0] for r in reduced.transform(df).select("components").collect()])
    assert np.cov(white.T) == pytest.approx(np.eye(3), abs=1e-6)


def test_search_finds_the_steepest_fall(blobs):
    search = cl.search_k(blobs, "v", [1 + 1, 3, 4], seed=2)
    assert search.count() == 3
    assert cl.best_k(search).first()["n_clusters"] == 3


def network_by_hand(layers, x):
    for layer in layers:
        x = x @ np.array(layer.weights) + np.array(layer.bias)
        x = sc.activation(layer.activation)(x)
    return x


@pytest.mark.parametrize("name", ["relu", "tanh", "sigmoid"])
def test_scoring(spark, name):
    layers = [sc.Dense([[1.0, -1.0], [0.5, 2.0]], [0.1, 0.2], name), sc.Dense([[1.0], [-0.5]], [0.3])]
    data = [(0, [1.0, 3.0]), (1, [2.0, -2.0]), (2, None), (3, [1.0])]
    df = spark.createDataFrame(data, "id int, v array<float>")
    found = {r["id"]: r for r in sc.score_mlp(df, "id", "v", layers, 0.5).collect()}
    for i, v in data[:2]:
        norm = abs(sum(v)) or 1.0
        expected = network_by_hand(layers, np.array(v) / norm)[0]
        assert found[i]["prediction"] == pytest.approx(expected)
        assert found[i]["predicted_label"] == int(1 / (1 + math.exp(-expected)) >= 0.5)
    assert found[2]["prediction"] is None and found[3]["prediction"] is None


def test_unknown_activation(spark):
    df = spark.createDataFrame([(0, [1.0])], "id int, v array<float>")
    with pytest.raises(ValueError):
        sc.score_mlp(df, "id", "v", [sc.Dense([[1.0]], [0.0], "swish")], 0.5)


def test_rows_are_repeated_by_weight(spark):
    df = spark.createDataFrame([(0,), (1,)], "y int")
    assert rows(replicated(df, "y", {0: 0.5, 1: 1.6})) == [(0,), (1,), (1,), (1,)]


def test_training_learns(spark):
    rng = np.random.default_rng(0)
    data = [
        ((rng.random(3) + [2 * (i % 2), 1, 1]).tolist(), i % 2, i // 2 % 2) for i in range(120)
    ]
    df = spark.createDataFrame(data, "v array<double>, y int, fold int")
    out = train_folds(df, "v", "y", kind="logistic")
    assert out.count() == 2
    assert out.agg(F.min("max_sp")).first()[0] > 0.9


def test_training_after_an_observed_query(spark):
    seen = Observation()
    assert spark.range(5).observe(seen, F.count("*").alias("n")).count() == 5 and seen.get == {"n": 5}
    data = [([i % 7 + 3.0 * (i % 2), 1.0, 2.0], i % 2, i // 2 % 2) for i in range(60)]
    df = spark.createDataFrame(data, "v array<double>, y int, fold int")
    for kind in ("logistic", "mlp"):
        found = train_folds(df, "v", "y", kind=kind, max_iter=5).select("fold", "init").collect()
        assert sorted(map(tuple, found)) == [(0, 0), (1, 0)]


def test_fit_skips_unusable_vectors_and_takes_the_spread_from_the_data(spark):
    draw = np.random.default_rng(5)
    data = draw.normal(0, [1.0, 10.0, 0.1], (60, 3))
    rows_in = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(100, None), (101, [1.0]), (102, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows_in + odd, "id long, v array<double>").repartition(3)
    clean = df.where("id < 100")
    variances = cl.spread_params(clean, "v", "seuclidean")["variances"]
    assert variances == pytest.approx(data.var(0, ddof=1).tolist())
    found = cl.spread_params(clean, "v", "mahalanobis")["inverse_covariance"]
    assert np.allclose(found, np.linalg.inv(np.cov(data.T)))
    for metric in ("euclidean", "seuclidean", "mahalanobis"):
        for init in ("farthest_point", "proportional"):
            fit = cl.MetricKMeans(k=2, metric=metric, init=init, max_iter=3).fit(df, "v", "id")
            assert fit.skipped == 3 and len(fit.centers) == 2
    placed = fit.predict(df, "v").where("id >= 100").select("cluster").collect()
    assert len(placed) == 3
