"""Neighbours against all pairs, over many leaves and with ties."""

import numpy as np
import pytest

from tessera.operators import geometry

rng = np.random.default_rng(5)


@pytest.mark.parametrize("itself,k", [(True, 1), (False, 7)])
def test_equals_all_pairs_beyond_one_leaf(spark, monkeypatch, itself, k):
    for name, n in (("LEAF", 40), ("TASK_POINTS", 50)):
        monkeypatch.setattr(geometry, name, n)
    x = np.concatenate([rng.normal(size=(700, 3)), np.round(rng.normal(size=(300, 3))), np.zeros((250, 3)), [[30, 30, 30]]])
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    s = spark.createDataFrame([(*r, float(r[0] % 7)) for r in rows], "site long, sx double, sy double, sz double, value double")
    got = {}
    for r in geometry.neighbours(p, s, k, 2.0, itself).collect():
        got.setdefault(r.id, {})[r.r] = (r.site, r.value, r.d)
    for i, *c in rows:
        d = np.sqrt(((x - c) ** 2).sum(1))
        d[d > 2.0] = np.inf
        if not itself:
            d[i] = np.inf
        want = [j for j in np.lexsort((np.arange(len(d)), d))[:k] if np.isfinite(d[j])]
        mine = got.get(i, {})
        assert [mine[r][0] for r in range(1, len(mine) + 1)] == want
        assert all(mine[r + 1][1] == j % 7 and np.isclose(mine[r + 1][2], d[j]) for r, j in enumerate(want))


def test_more_sites_than_were_once_taken(spark):
    s = spark.range(100_001).selectExpr("id as site", "cast(id as double) as sx", "0d as sy", "0d as sz", "1d as value")
    p = spark.createDataFrame([(7, 70_000.4, 0.0, 0.0)], "id long, x double, y double, z double")
    assert [(r.site, round(r.d, 6)) for r in geometry.nearest(p, s).collect()] == [(70_000, 0.4)]
