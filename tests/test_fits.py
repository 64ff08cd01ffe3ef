"""Fits without a SQL twin against Newton steps in numpy."""

import numpy as np
import pytest

from plumbline.operators import calibrate as C
from plumbline.operators import probes as P


def newton(x, y, w, ridge):
    """Weighted logistic fit with an intercept; `ridge` is added to the mean loss as ridge / 2 * |coefficients|^2."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, pen = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) / w.sum() + pen * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + np.diag(pen)
        beta = beta - np.linalg.solve(hess, grad)
    return beta


@pytest.mark.parametrize("n", [120, 600])
def test_platt_matches_newton(spark, n):
    draw = np.random.default_rng(n)
    prob = draw.uniform(0.02, 0.98, n)
    y = (draw.random(n) < 1 / (1 + np.exp(-(0.6 * np.log(prob / (1 - prob)) - 0.4)))).astype(int)
    df = spark.createDataFrame([(float(p), int(v)) for p, v in zip(prob, y)], "prob double, label int")
    target = y.astype(float)
    if n < 200:
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (n - y.sum() + 2))
    z = np.log(prob / (1 - prob))[:, None]
    want = newton(np.vstack([z, z]), np.repeat([1.0, 0.0], n), np.concatenate([target, 1 - target]), 0.0)
    assert C.fit_platt(df) == pytest.approx(tuple(want), abs=2e-3)


@pytest.mark.parametrize("balanced", [False, True])
def test_linear_probe_matches_newton(spark, balanced):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 4)) * [1, 5, 0.2, 1] + [0, 3, 1, 0]
    y = (draw.random(300) < 1 / (1 + np.exp(-(x[:, 0] + 0.3 * x[:, 1] - 2.5)))).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, v array<double>, label int")
    ready = P.as_features(df)
    probe = P.linear_probe(ready, balanced=balanced)
    counts = np.bincount(y)
    w = 300 / (2 * counts[y]) if balanced else np.ones(300)
    # weights shift the scaler too: its mean and deviation do not use them
    scaled = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want = newton(scaled, y, w, 299 / 300**2)
    got = {r.id: r.score for r in probe.score(ready).select("id", "score").collect()}
    expected = scaled @ want[:-1] + want[-1]
    assert np.corrcoef([got[i] for i in range(300)], expected)[0, 1] > 0.9999
    assert np.abs(np.array([got[i] for i in range(300)]) - expected).max() < 0.05


def test_a_probe_takes_many_classes_and_needs_two(spark):
    rows = [(i, [float(i % 300 == k) for k in range(3)], i % 300) for i in range(600)]
    df = P.as_features(spark.createDataFrame(rows, "id long, v array<double>, label int"))
    with pytest.raises(ValueError):
        P.linear_probe(df.filter("label = 1"))
    probe = P.linear_probe(df.filter("label < 3 or label > 296"), multiclass=True, max_iter=20)
    assert probe.predict(df.filter("label < 3")).filter("predicted = label").count() == 6
