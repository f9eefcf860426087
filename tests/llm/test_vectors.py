"""Clustering and hard negatives against plain numpy, with every odd row in the table."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calorix.llm.centroid_clusters import (
    Bounds,
    ClusterRules,
    cell_numbers,
    cluster_vectors,
    packed_cells,
    with_inertia,
)
from calorix.llm.hard_negatives import NegativeRules, mine_negatives, score_type

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        # names that the operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("id", "vector", "v", "row", "codes", "cluster", "k", "slot")],
    ]
)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], SCHEMA).repartition(3)


def vectors(n=160, size=8, seed=0):
    draw = np.random.default_rng(seed)
    out = [(k, [float(x) for x in draw.normal(0, 0.5, size)], int(draw.integers(0, 4))) for k in range(n)]
    out += [(3, out[3][1], 1), (3, out[9][1], 2), (40, out[40][1], out[40][2])]
    out += [(n + k, out[5][1], k % 3) for k in range(20)]
    out += [(900, [100.0] * size, 1), (901, [-0.001] * size, 2), (902, [0.0] * size, 3)]
    return out


ODD = [
    (950, None, 1),
    (951, [], 1),
    (952, [1.0] * 7, 1),
    (953, [None] + [1.0] * 7, 1),
    (954, [math.nan] + [1.0] * 7, 1),
    (955, [math.inf] + [1.0] * 7, 1),
    (956, [1.0] * 9, 2),
]


def brute_clusters(rows, rules):
    kept = [
        (i, [math.floor(rules.scale * x) for x in v])
        for i, v, _ in rows
        if v is not None and len(v) == rules.size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(
        kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{rules.salt}{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes())
    )
    centers = [v for _, v in order[: rules.k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers))

    for _ in range(rules.rounds):
        place = [near(v)[1] for _, v in kept]
        for k in range(len(centers)):
            own = [v for (_, v), p in zip(kept, place, strict=True) if p == k]
            if own:
                centers[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return sorted(out, key=repr), centers


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_clusters_are_those_of_plain_rounds(spark, bits):
    rules = ClusterRules(k=6, rounds=3, size=8, bits=bits)
    rows = vectors() + ODD + [(None, vectors()[0][1], 1)]
    placed, centers = cluster_vectors(table_of(spark, rows), rules=rules)
    expected, at = brute_clusters(rows, rules)
    assert sorted(map(tuple, placed.collect()), key=repr) == expected
    assert centers.tolist() == at
    about = with_inertia(placed, centers).collect()
    assert {r["inertia"] for r in about} == {sum(d for _, _, d in expected)}
    for r in about:
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        text = ",".join(map(str, at[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_fewer_vectors_than_centroids_and_none(spark):
    rules = ClusterRules(k=6, rounds=2, size=8)
    placed, centers = cluster_vectors(table_of(spark, vectors()[:3]), rules=rules)
    assert len(centers) == 3 and placed.count() == 3
    assert {r["distance"] for r in placed.collect()} == {0}
    placed, centers = cluster_vectors(table_of(spark, ODD), rules=rules)
    assert placed.count() == 0 and with_inertia(placed, centers).count() == 0
    same = [(k, [0.5] * 8, 1) for k in range(30)]
    placed, _ = cluster_vectors(table_of(spark, same), rules=rules)
    assert {(r["cluster"], r["distance"]) for r in placed.collect()} == {(0, 0)}


def test_bounds_hold_and_few_vectors_are_fetched():
    draw = np.random.default_rng(1)
    centers = draw.integers(-500, 500, (5, 8))
    v = np.concatenate([c + draw.integers(-20, 20, (200, 8)) for c in centers])
    first = np.linspace(v.min(0), v.max(0), 17)[:-1].T.astype(np.int64)
    last = np.concatenate([first[:, 1:] - 1, v.max(0)[:, None]], axis=1)
    codes = packed_cells(cell_numbers(v, first), 4)
    bounds = Bounds(centers, first, last, 4)
    d = ((v[:, None] - centers) ** 2).sum(axis=2)
    low = sum(bounds.low[g][codes[:, g]] for g in range(codes.shape[1]))
    high = sum(bounds.high[g][codes[:, g]] for g in range(codes.shape[1]))
    assert (low <= d).all() and (d <= high).all()
    place, fetched = bounds.nearest(codes, v.astype(np.int32))
    assert (place == d.argmin(axis=1)).all() and fetched < len(v) // 10


def brute_negatives(rows, rules, every):
    size = max(len(v) for _, v, _ in rows if v is not None)
    kept = [
        (i, [math.floor(256 * x) for x in v] + [0] * (size - len(v)), y)
        for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i % every:
            continue
        scored = [
            (-sum(p * q for p, q in zip(v, w, strict=True)), j, z == y) for b, (j, w, z) in enumerate(kept) if b != a
        ]
        scored.sort(key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2]][: rules.positives]:
            fit = [(t, k) for t, k, same in scored if not same and rules.num * -s <= rules.den * -t <= rules.den * -s]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[: rules.negatives])]
    return sorted(out)


@pytest.mark.parametrize("rules", [NegativeRules(), NegativeRules(3, 4, anchors=2, shares=3, rows=4), NegativeRules(5, 2, num=10)])
def test_negatives_are_those_of_all_pairs(spark, rules):
    rows = vectors(90) + ODD + [(500, [0.5] * 8, None), (None, [0.5] * 8, 1), (90, [0.1] * 3, 2), (990, [0.1] * 8, 77)]
    found = mine_negatives(table_of(spark, rows), F.col("id") % 10 == 0, rules=rules)
    expected = brute_negatives(rows, rules, 10)
    assert expected
    assert sorted(map(tuple, found.collect())) == expected


def test_many_equal_vectors_fall_in_one_slot(spark):
    rows = [(k, [0.5, 0.25], k % 2) for k in range(200)] + [(400, [0.4, 0.3], 0)]
    rules = NegativeRules(anchors=5, shares=4, rows=16)
    found = mine_negatives(table_of(spark, rows), F.col("id") % 50 == 0, rules=rules)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, rules, 50)


def test_no_rows_give_no_negatives(spark):
    assert mine_negatives(table_of(spark, []), F.col("id") % 10 == 0).count() == 0
    alone = [(0, [1.0], 0), (1, [1.0], 1)]
    assert mine_negatives(table_of(spark, alone), F.col("id") % 10 == 0).count() == 0


def test_scores_have_an_exact_type():
    assert score_type(64, 256) is np.float32
    assert score_type(64, 4096) is np.float64
    with pytest.raises(ValueError):
        score_type(64, 1 << 24)
