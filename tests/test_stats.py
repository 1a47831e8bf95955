import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import recording, stats


def test_known_tails():
    assert math.isclose(stats.t_tail(11.335049583473713, 18), 1.256342249131581e-09, rel_tol=1e-9)
    assert math.isclose(stats.t_tail(2.2281388519649385, 10), 0.05, rel_tol=1e-9) and math.isclose(stats.f_tail(4.102821015, 2, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.t_tail(-1.0, 5, "less") + stats.t_tail(-1.0, 5, "greater"), 1) and math.isnan(stats.t_tail(None, 3))


def test_controlled_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 200
    c, k, g = rng.integers(0, 2, n), rng.normal(size=n), rng.integers(0, 3, n)
    y = 1 + 0.5 * c + 2 * k - g + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), int(b), float(e), int(f)) for a, b, e, f in zip(y, c, k, g)] + [(None, 1, 0.0, 0)], "y double, c int, k double, g int")
    got = stats.ttest_controlled(df, F.col("y"), {"c": F.col("c"), "k": F.col("k"), "g1": (F.col("g") == 1).cast("int"), "g2": (F.col("g") == 2).cast("int")}, "c").first()
    x = np.column_stack([np.ones(n), c, k, g == 1, g == 2]).astype(float)
    b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    want = b[1] / math.sqrt(rss[0] / (n - 5) * np.linalg.inv(x.T @ x)[1, 1])
    assert math.isclose(got.t, want, rel_tol=1e-9) and got.df == n - 5


def test_wilks_of_three_features_and_families(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 2, int(lab), *map(float, rng.normal(size=3) + lab)) for i, lab in enumerate(rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "e int, label int, a double, b double, c double")
    for r in stats.wilks_lambda(df, ["a", "b", "c"], by=("e",)).collect():
        d, lab = np.array([x[2:] for x in rows if x[0] == r.e]), np.array([x[1] for x in rows if x[0] == r.e])
        within = sum(np.cov(d[lab == k].T, bias=True) * (lab == k).sum() for k in range(3))
        lam = np.linalg.det(within) / np.linalg.det(np.cov(d.T, bias=True) * len(d))
        f = (1 - lam ** (1 / 3)) / lam ** (1 / 3) * (len(d) - 3) / 6
        assert math.isclose(r.f, f, rel_tol=1e-8) and 0 <= r.p < 1e-6


def test_mixed_model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(5):
        x = rng.uniform(size=(60, 2))
        rows += [(s, float(a), float(b), float(a - 2 * b + s + 0.1 * rng.normal())) for a, b in x]
    df = spark.createDataFrame(rows, "s int, a double, b double, y double")
    m = stats.MixedModel().fit(df, ["a", "b"], "y", "s")
    coef = {r.feature: r for r in m.params(df).collect()}
    assert abs(coef["a"].coef - 1) < 0.1 and abs(coef["b"].coef + 2) < 0.1 and coef["a"].low < coef["a"].coef < coef["a"].high and coef["b"].p < 1e-6
    y, x, s = np.array([r[3] for r in rows]), np.array([[1, r[1], r[2]] for r in rows]), np.array([r[0] for r in rows])

    def likelihood(ratio):
        v = np.eye(len(y)) + ratio * (s[:, None] == s)
        vi = np.linalg.inv(v)
        a = x.T @ vi @ x
        rss = (r := y - x @ np.linalg.solve(a, x.T @ vi @ y)) @ vi @ r
        return -0.5 * ((len(y) - 3) * math.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1])

    assert likelihood(m.ratio) >= max(likelihood(m.ratio * 1.2), likelihood(m.ratio / 1.2)) - 1e-6


def test_responsive_errors(spark):
    df = spark.createDataFrame([(0, t, 0, float(t)) for t in range(30)], "trial_id int, t int, ch int, x double")
    with pytest.raises(ValueError):
        stats.responsive_ttest(df, 0.1, 10.0)
    with pytest.raises(ValueError):
        stats.responsive_ttest(df, 1.0, 10.0, [-1.0, 1.0])
    assert 0 <= stats.responsive_ttest(df, 1.0, 10.0).first().p < 1e-6


def test_resampled_labels_and_contacts(spark):
    x = [1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(x)], "trial_id int, t long, label int")
    got = lambda n: [r.label for r in recording.resample_categorical(df, n).orderBy("t").collect()]
    assert got(8) == [1, 1, 2, 3, 4, 4, 5, 5] and got(20) == [1] * 5 + [2] * 3 + [3] * 2 + [4] * 5 + [5] * 5
    names = spark.createDataFrame([(0, "LT1"), (1, "LT2"), (2, "LT4"), (3, "GA1"), (4, "LT3")], "ch int, name string")
    assert sorted(tuple(r) for r in recording.local_reference(names).collect()) == [(0, 1), (1, 0), (1, 4), (2, 4), (4, 1), (4, 2)]
