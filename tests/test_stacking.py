"""Nested cross-fitting against direct fits in NumPy."""

import numpy as np
import pytest

from marlstone.operators import stacking as K

MODELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(2)
    n = 600
    truth = r.normal(size=n)
    y = (r.random(n) < 1 / (1 + np.exp(-2 * truth))).astype(int)
    squash = lambda z: 1 / (1 + np.exp(-z))
    x = np.stack([squash(truth + 0.5 * r.normal(size=n)), squash(0.3 * truth + r.normal(size=n)), squash(r.normal(size=n))], 1)
    return x, y, np.arange(n) % 3, np.arange(n) % 40


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, fold, group = data
    rows = [(i, int(group[i]), int(y[i]), int(fold[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, g long, label int, fold int, a double, b double, c double").repartition(3).cache()


def stack_of(x, y):
    z = np.concatenate([np.log(x / (1 - x)), np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return w


def loss(p, y):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -np.where(y > 0, np.log(p), np.log(1 - p))


def test_all_fits_are_the_best_ones(data, table):
    x, y, fold, _ = data
    sets = [frozenset(s) for s in ((), (0,), (1, 2))]
    fitted = K.fit_all(table, MODELS, "label", "fold", sets)
    r = np.random.default_rng(0)
    for s in sets:
        own = ~np.isin(fold, list(s))
        assert np.abs(fitted.stack[s] - stack_of(x[own], y[own])).max() < 1e-5
        w = fitted.weights[s]
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9
        least = loss(x[own] @ w, y[own]).sum()
        for other in r.dirichlet(np.ones(3), 300):
            assert loss(x[own] @ other, y[own]).sum() >= least - 1e-6
            assert loss(x[own] @ (0.99 * w + 0.01 * other), y[own]).sum() >= least - 1e-6


def test_nested(data, table):
    x, y, fold, group = data
    rows, report, fitted = K.nested_ensemble(table, MODELS, "label", "fold", "g")
    got = {r["id"]: r for r in rows.collect()}
    assert len(got) == len(y)
    for f in range(3):
        own, rest = fold == f, fold != f
        z = np.concatenate([np.log(x / (1 - x)), np.ones((len(x), 1))], 1)
        assert np.abs(1 / (1 + np.exp(-z[own] @ stack_of(x[rest], y[rest]))) - [got[i]["logistic"] for i in np.flatnonzero(own)]).max() < 1e-6
        inner = {}
        for m in K.METHODS:
            total = 0
            for g in {0, 1, 2} - {f}:
                at, left = fold == g, ~np.isin(fold, [f, g])
                if m == "logistic":
                    p = 1 / (1 + np.exp(-z[at] @ stack_of(x[left], y[left])))
                elif m == "weighted":
                    p = x[at] @ fitted.weights[frozenset([f, g])]
                elif m == "average":
                    p = x[at].mean(1)
                elif m == "geometric":
                    p = np.exp(np.log(x[at]).mean(1))
                else:
                    ranks = np.stack([[(x[group == group[i], j] <= x[i, j]).sum() / (group == group[i]).sum() for i in np.flatnonzero(at)] for j in range(3)])
                    p = ranks.mean(0)
                total += loss(p, y[at]).sum()
            inner[m] = total
        assert {got[i]["method"] for i in np.flatnonzero(own)} == {min(inner, key=inner.get)}
        assert all(got[i]["blend"] == got[i][got[i]["method"]] for i in np.flatnonzero(own))
    losses = {r["method"]: r["log_loss"] for r in report.collect()}
    assert set(losses) == {*K.METHODS, "chosen"}
    assert losses["average"] == pytest.approx(loss(x.mean(1), y).mean())
    assert losses["chosen"] <= min(losses[m] for m in K.METHODS) + 0.01
    full = {r["id"]: r["blend"] for r in K.predict_full(table, fitted, "weighted", "g").collect()}
    assert full[0] == pytest.approx(float(x[0] @ fitted.weights[frozenset()]))
    assert K.predict_full(table.limit(0), fitted, "rank", "g").collect() == []


def test_one_fold_is_refused(table):
    with pytest.raises(ValueError):
        K.nested_ensemble(table.where("fold = 0"), MODELS, "label", "fold", "g")
