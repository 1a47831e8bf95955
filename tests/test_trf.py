"""Delay models against ridge regression over arrays."""

import numpy as np
import pytest

from tessera.operators.trf import ALPHAS, TRF


def brute(x, y, alphas):
    def solve(x, y, a):
        mx, my = x.mean(0), y.mean(0)
        w = np.linalg.solve((x - mx).T @ (x - mx) + a * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        return w, my - mx @ w

    r2 = lambda x, y, w, b: np.mean(1 - ((y - x @ w - b) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0))
    parts = np.array_split(np.arange(len(x)), 5)
    means = [np.mean([r2(x[f], y[f], *solve(np.delete(x, f, 0), np.delete(y, f, 0), a)) for f in parts]) for a in alphas]
    a = alphas[int(np.argmax(means))]
    w, b = solve(x, y, a)
    return a, w, b, r2(x, y, w, b)


def test_lags_features_targets_and_penalty(spark):
    rng = np.random.default_rng(1)
    rows, delayed = [], []
    for trial, n in enumerate((61, 40, 83)):
        u = rng.normal(3, 1, (n, 2))
        lag = np.stack([np.r_[np.zeros(max(d, 0)), u[max(-d, 0) : n - max(d, 0), f], np.zeros(max(-d, 0))] for f in range(2) for d in range(-1, 3)], 1)
        y = np.stack([lag @ rng.normal(size=8) + rng.normal(size=n), rng.normal(size=n), lag[:, 2] + 100], 1)
        delayed.append((lag, y))
        rows += [(trial, t, *map(float, [*u[t], *y[t]])) for t in range(n)]
    x, y = (np.concatenate(a) for a in zip(*delayed))
    df = spark.createDataFrame(rows, "trial_id long, t long, a double, b double, y0 double, y1 double, y2 double").repartition(5)
    targets = {"one": ["y0"], "noise": ["y1"], "two": ["y1", "y2"]}
    model = TRF(-0.1, 0.2, 10).fit(df, ["a", "b"], targets)
    got = {r.target: (r.r2, r.r) for r in model.score(df).collect()}
    predicted = {(r.trial_id, r.t, r.target, r.output): r.p for r in model.predict(df).collect()}
    coef = {(r.target, r.output, r.feature, r.lag): r.coef for r in model.coefficients(df).collect()}
    alphas = set()
    for name, columns in targets.items():
        out = y[:, [int(c[1]) for c in columns]]
        a, w, b, r2 = brute(x, out, ALPHAS)
        alphas.add(a)
        p = x @ w + b
        assert model.alpha[name] == a and np.isclose(got[name][0], r2)
        assert np.isclose(got[name][1], np.corrcoef(p.ravel(), out.ravel())[0, 1])
        for j, c in enumerate(columns):
            assert np.allclose([predicted[r[0], r[1], name, c] for r in rows], p[:, j])
            assert np.allclose([coef[name, c, f, lag] for f in "ab" for lag in range(-1, 3)], w[:, j])
    assert len(alphas) > 1


def test_missing_values_and_too_few_samples(spark):
    df = spark.createDataFrame([(0, t, None if t == 3 else float(t), 1.0) for t in range(9)], "trial_id long, t long, x double, y double")
    with pytest.raises(ValueError, match="missing"):
        TRF(0, 1).fit(df, ["x"], {"y": ["y"]})
    with pytest.raises(ValueError, match="fewer"):
        TRF(0, 1).fit(df.filter("t > 5"), ["x"], {"y": ["y"]})
