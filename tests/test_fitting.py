"""Training with early stop against a plain numpy loop over the same mini-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorix.operators import fitting
from calorix.operators.fitting import TrainingRules, train_networks, training_report
from calorix.operators.metrics import log_loss, max_sp_metrics
from calorix.operators.scoring import score_mlp

RULES = TrainingRules(hidden=(5, 3), batches=3, max_epochs=12, patience=2, inits=2, rate=0.02, seed=4)


@pytest.fixture(scope="module")
def samples(spark):
    draw = np.random.default_rng(0)
    rows = []
    for k in range(300):
        y = int(draw.random() < 0.3)
        x = draw.random(6) + y * np.array([0.6, 0, 0.4, 0, 0, 0])
        rows.append((k, [float(v) for v in x], y, k % 3))
    rows += [(900, None, 1, 0), (901, [1.0], 1, 0), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1)]
    rows += [(903, [1.0] * 6, None, 0), (904, [1.0] * 6, 1, -1), (905, [1.0] * 6, 0, None)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int, fold int").repartition(3)


def numpy_run(samples, rules):
    rows = samples.where("id < 900").withColumn("b", fitting.mini_batch("id", rules)).orderBy("id").collect()
    x = np.array([r["v"] for r in rows])
    x = x / np.abs(x.sum(1))[:, None]
    y, fold, b = (np.array([r[c] for r in rows]) for c in ("y", "fold", "b"))
    sizes = [6, *rules.hidden, 1]
    out = {}
    for own in range(3):
        for init in range(rules.inits):
            flat = fitting.first_weights(fitting.layer_shapes(6, rules.hidden), (rules.seed, own, init))
            m = v = np.zeros(len(flat))
            train = fold != own
            count = np.bincount(y[train], minlength=2)
            cost = train.sum() / (2 * count)

            def run(w, x):
                acts, at = [x], 0
                for k, (p, q) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
                    z = acts[-1] @ w[at : at + p * q].reshape(p, q) + w[at + p * q : at + p * q + q]
                    at += p * q + q
                    acts.append(z if k == len(sizes) - 2 else np.maximum(z, 0))
                return acts

            best = (-1.0, 0, None)
            target, wait, step = -np.inf, 0, 0
            for epoch in range(1, rules.max_epochs + 1):
                for k in range(rules.batches):
                    use = train & (b == k)
                    # the gradient by central differences of the mean weighted loss

                    def loss(w, use=use, cost=cost):
                        z = run(w, x[use])[-1][:, 0]
                        each = np.maximum(z, 0) - z * y[use] + np.log1p(np.exp(-np.abs(z)))
                        return (each * cost[y[use]]).mean()

                    g = np.array([(loss(flat + e) - loss(flat - e)) / 2e-6 for e in np.eye(len(flat)) * 1e-6])
                    step += 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    flat = flat - rules.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                p = 1 / (1 + np.exp(-run(flat, x[fold == own])[-1][:, 0]))
                t = y[fold == own]
                sp = []
                for level in np.arange(100) / 99:
                    tpr, fpr = (p[t == 1] >= level).mean(), (p[t == 0] >= level).mean()
                    sp.append(np.sqrt(np.sqrt(tpr * (1 - fpr)) * (tpr + 1 - fpr) / 2))
                if max(sp) > best[0]:
                    best = (max(sp), epoch, flat.copy())
                if max(sp) - rules.min_delta > target:
                    target, wait = max(sp), 0
                else:
                    wait += 1
                if wait >= rules.patience:
                    break
            out[own, init] = (*best, epoch)
    return out


def test_early_stop_returns_the_best_epoch_of_a_numpy_loop(spark, samples):
    states = train_networks(samples, "v", "y", "id", rules=RULES)
    expected = numpy_run(samples, RULES)
    assert {(s.fold, s.init) for s in states} == set(expected)
    assert any(s.epoch < RULES.max_epochs for s in states)
    assert any(s.best_epoch < s.epoch for s in states)
    for s in states:
        sp, best_epoch, weights, epochs = expected[s.fold, s.init]
        assert (s.epoch, s.best_epoch) == (epochs, best_epoch)
        assert s.record["max_sp"] == pytest.approx(sp, abs=1e-6)
        assert np.allclose(s.best, weights, atol=1e-4)


def test_report_agrees_with_scoring_the_best_network(spark, samples):
    rules = TrainingRules(hidden=(4,), batches=2, max_epochs=3, rate=0.05)
    states = train_networks(samples, "v", "y", "id", rules=rules)
    report = {r["fold"]: r for r in training_report(spark, states).collect()}
    for s in states:
        own = samples.where((F.col("fold") == s.fold) & (F.col("id") < 900))
        layers = fitting.network_layers(s, 6, rules)
        scored = score_mlp(own, "id", "v", layers, 0.5).join(samples.select("id", "y"), "id")
        point = max_sp_metrics(scored, "y", "proba").first().asDict()
        for name, value in point.items():
            assert report[s.fold][name] == pytest.approx(value, abs=1e-9), name
        assert report[s.fold]["loss"] == pytest.approx(log_loss(scored, "y", "proba").first()["mean_loss"])


def test_a_broken_run_goes_on_with_the_same_result(spark, samples, monkeypatch):
    rules = TrainingRules(hidden=(4,), batches=2, max_epochs=4, patience=9, rate=0.05, inits=2)
    whole = train_networks(samples, "v", "y", "id", rules=rules)
    calls = []
    real = fitting.validation_sweeps

    def breaks(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(fitting, "validation_sweeps", breaks)
    with pytest.raises(RuntimeError):
        train_networks(samples, "v", "y", "id", rules=rules, run="broken")
    monkeypatch.setattr(fitting, "validation_sweeps", real)
    resumed = train_networks(samples, "v", "y", "id", rules=rules, run="broken")
    for a, b in zip(whole, resumed, strict=True):
        assert (a.fold, a.init, a.epoch, a.best_epoch) == (b.fold, b.init, b.epoch, b.best_epoch)
        assert np.allclose(a.best, b.best, atol=1e-9)
        assert a.record == pytest.approx(b.record)


def test_scans_do_not_grow_with_folds_and_starts(spark, samples, monkeypatch):
    scans = []
    real = fitting._summed
    monkeypatch.setattr(fitting, "_summed", lambda found: scans.append(1) or real(found))
    for inits in (1, 3):
        scans.clear()
        rules = TrainingRules(hidden=(2,), batches=2, max_epochs=2, patience=9, inits=inits)
        train_networks(samples, "v", "y", "id", rules=rules)
        assert len(scans) == 2 * (2 + 1)


def test_no_rows_are_an_error(spark, samples):
    with pytest.raises(ValueError):
        train_networks(samples.where("fold < 0"), "v", "y", "id")
