"""Fits that share their scans against plain numpy; starts in a few rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorix.operators import clusters as cl
from calorix.operators import fits
from calorix.operators.fits import ALL, Fit, FitRules, candidates, fit_many, fit_table, run_fits


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    middles = draw.normal(0, 6, (9, 3))
    data = [(k, (middles[k % 9] + draw.normal(0, 0.3, 3)).tolist(), k % 3) for k in range(270)]
    data += [(900, None, 0), (901, [1.0], 1), (902, [None, 1.0, 1.0], 2), (903, [0.0] * 3, None)]
    return spark.createDataFrame(data, "id long, v array<double>, fold int").repartition(4)


def points(rows):
    held = rows.where("id < 900").orderBy("id").collect()
    return np.array([r["v"] for r in held]), np.array([r["fold"] for r in held])


def lloyd(x, c, rules):
    old = np.inf
    for _ in range(rules.max_iter):
        d = ((x[:, None] - c) ** 2).sum(2)
        near, inertia = d.argmin(1), d.min(1).sum()
        if np.isclose(inertia, old, rtol=rules.tol):
            break
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        old = inertia
    return inertia, c


def test_each_fit_ends_as_if_alone(rows):
    table = fit_table(rows, "v", "id", "fold")
    x, fold = points(rows)
    rules = FitRules(max_iter=30)
    asked = [Fit(f, x[fold != f][s : s + 4 * k : 4].copy(), s) for f in (0, 1, 2) for k in (2, 5) for s in (0, 3)]
    starts = [f.centers.copy() for f in asked]
    run_fits(table, asked, rules)
    for f, start in zip(asked, starts, strict=True):
        inertia, centers = lloyd(x[fold != f.fold], start, rules)
        assert f.inertia == pytest.approx(inertia)
        assert f.rows == (fold != f.fold).sum()
        assert np.allclose(f.centers, centers, atol=1e-2)


def test_scans_do_not_grow_with_folds_sizes_and_starts(rows, monkeypatch):
    table = fit_table(rows, "v", "id", "fold")
    scans = []
    step, drawn = fits._step, fits._drawn
    monkeypatch.setattr(fits, "_step", lambda *a: scans.append(1) or step(*a))
    monkeypatch.setattr(fits, "_drawn", lambda *a: scans.append(1) or drawn(*a))
    rules = FitRules(max_iter=3, tol=0.0, rounds=2)
    counts = []
    for ks, folds, starts in (([2], [0], 1), ([2, 4, 6], [0, 1, 2], 3)):
        scans.clear()
        found = fit_many(table, ks, folds, starts, rules)
        counts.append(len(scans) - max(f.steps for f in found))
    assert counts == [rules.rounds + 2] * 2


@pytest.mark.parametrize("farthest", [False, True])
def test_starts_are_about_as_good_as_those_of_a_scan_per_centre(rows, farthest):
    table = fit_table(rows.where("fold >= 0"), "v", "id")
    x, _ = points(rows)
    held = candidates(table, [ALL], 9, FitRules(farthest=farthest))
    rules = FitRules(farthest=farthest)
    few = fits.chosen_starts(*held[ALL], 9, 0, rules, fits.candidate_distance(None, rules))
    one = cl.farthest_point_init if farthest else cl.proportional_init
    many = np.array(one(rows.where("id < 900"), "v", "id", 9, 0, metric="sqeuclidean"))

    def cost(c):
        return ((x[:, None] - c) ** 2).sum(2).min(1).sum()

    assert cost(few) <= 1.5 * cost(many) + 1e-9
    # candidates are rows, all rows are counted once
    assert held[ALL][1].sum() == len(x)
    assert all((x == c).all(1).any() for c in held[ALL][0])


@pytest.mark.parametrize(
    ("metric", "params"),
    [("cityblock", {}), ("minkowski", {"p": 3}), ("jaccard", {}), ("cosine", {})],
)
def test_any_metric_has_few_scan_starts(rows, metric, params):
    table = fit_table(rows, "v", "id", "fold")
    found = fit_many(table, [3], [0, 2], 2, FitRules(metric, params, max_iter=3, rounds=2))
    assert [(f.fold, f.start, len(f.centers) <= 3) for f in found] == [(f, s, True) for f in (0, 2) for s in (0, 1)]
    assert all(np.isfinite(f.inertia) for f in found)


@pytest.mark.parametrize("init", ["candidates", "farthest_candidates"])
def test_candidate_starts_find_separate_groups(rows, init):
    model = cl.MetricKMeans(k=9, init=init, n_init=2, metric="sqeuclidean").fit(rows, "v", "id")
    x, _ = points(rows)
    assert model.skipped == 3
    assert model.inertia == pytest.approx(sum(((x[k::9] - x[k::9].mean(0)) ** 2).sum() for k in range(9)), rel=0.2)


def test_few_different_rows_make_few_centres(spark):
    df = spark.createDataFrame([(k, [float(k % 2)]) for k in range(20)], "id long, v array<double>")
    found = fit_many(fit_table(df, "v", "id"), [1, 2, 5])
    assert [(f.size, len(f.centers)) for f in found] == [(1, 1), (2, 2), (5, 2)]
    assert found[2].inertia == 0.0
    with pytest.raises(ValueError):
        fit_many(fit_table(df.limit(0), "v", "id"), [2])


def test_fold_search_scores_the_chosen_size_on_its_own_fold(rows):
    out = {r["fold"]: r for r in cl.kfold_search(rows, "v", [2, 4, 9], id_col="id", starts=2).collect()}
    x, fold = points(rows)
    for f in (0, 1, 2):
        assert out[f]["n_val"] == (fold == f).sum()
        assert out[f]["n_clusters"] in (4, 9)
        assert out[f]["train_inertia"] > 0 and out[f]["val_inertia"] > 0


def test_a_retried_draw_takes_the_same_rows(rows):
    table = fit_table(rows, "v", "id")
    a, b = (candidates(t, [ALL], 3, FitRules(rounds=2)) for t in (table, table.repartition(7, F.col("bits"))))
    assert a[ALL][0].tolist() == b[ALL][0].tolist()
    assert a[ALL][1].tolist() == b[ALL][1].tolist()
