"""Platt, beta and isotonic calibration against direct fits."""

import numpy as np
import pytest

from marlstone.operators import calibration as C


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    p = r.random(800).round(3)
    y = (r.random(800) < p**1.7).astype(int)
    return p, y


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, float(p), int(y)) for i, (p, y) in enumerate(zip(*rows, strict=True))], "id long, p double, label int").cache()


def logistic(z, y, strength):
    """Mean log loss plus half the squared coefficients times strength, on standardised columns, as MLlib has it."""
    scale = z.std(0, ddof=1)
    x = np.concatenate([z / scale, np.ones((len(z), 1))], 1)
    ridge = np.diag([strength] * z.shape[1] + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge, x.T @ (q - y) / len(x) + ridge @ w)
    return 1 / (1 + np.exp(-x @ w))


def monotone(p, y):
    """Pool adjacent violators over rows of equal p."""
    blocks = []
    for v in np.unique(p):
        blocks.append([y[p == v].mean(), int((p == v).sum()), [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    return {v: m for m, _, vs in blocks for v in vs}


def calibrated(table, method):
    return np.array([r["calibrated"] for r in C.calibrate(table, table, "label", "p", method).orderBy("id").collect()])


def test_platt_and_beta(rows, table):
    p, y = rows
    q = np.clip(p, 1e-6, 1 - 1e-6)
    assert np.abs(calibrated(table, "platt") - logistic(np.log(q / (1 - q))[:, None], y, 1e-6)).max() < 1e-3
    assert np.abs(calibrated(table, "beta") - logistic(np.stack([np.log(q), np.log(1 - q)], 1), y, 1e-6)).max() < 2e-3


def test_isotonic(rows, table):
    p, y = rows
    want = monotone(p, y)
    assert np.abs(calibrated(table, "isotonic") - np.clip([want[v] for v in p], 1e-6, 1 - 1e-6)).max() < 1e-9


def test_identity(rows, table):
    assert (calibrated(table, "identity") == rows[0]).all()
