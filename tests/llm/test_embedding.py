import duckdb
import numpy as np
import pytest

from tessera.llm import embedding_dedup as E


def brute(rows, threshold=0.93):
    vs = [E.usable(v) if label is not None else None for _, v, label in rows]
    ok = lambda i, j: i != j and vs[i] is not None and vs[j] is not None and rows[i][2] == rows[j][2] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / np.linalg.norm(vs[i]) / np.linalg.norm(vs[j]) >= threshold
    near = [[j for j in range(len(rows)) if ok(i, j)] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), c, rows[i][0] is None or rows[i][0] == c if c is not None else True))
    return sorted(out, key=str)


def test_edges_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(25):
        c = rng.normal(size=20)
        rows += [(len(rows) + i, [float(x) for x in c + 0.12 * rng.normal(size=20)], g % 3) for i in range(rng.integers(1, 6))]
    v = rows[0][1]
    rows += [(-1, None, 1), (-2, [0.0] * 20, 1), (-3, [1.0, None] * 10, 1), (-4, [float("nan")] * 20, 1), (-5, [float("inf")] * 20, 1), (-6, [], 1), (-7, v, None), (0, v, 0), (500, v, 0), (None, v, 0), (501, [2 * x for x in v], 0), (502, v[:10], 0), (503, v[:10], 0), (504, [1.0], 2), (505, [-1.0], 2), (506, [3.0], 2)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = sorted((tuple(r) for r in E.deduplicated(df).collect()), key=str)
    assert got == brute(rows)
    assert E.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("rotations", list(E.PLANS))
@pytest.mark.parametrize("d", [16, 64])
def test_recall_at_the_threshold(rotations, d):
    """Pairs exactly at cosine 0.93: one lies in the buckets the other asks, in some table."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 2000, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1)[:, None]
    tables, probes = E.PLANS[rotations]
    a, b = (E.buckets(v, tables, rotations, probes, E.SEED) for v in (x, y))
    found = (a == b[:, :, :1]).any((1, 2)) | (b == a[:, :, :1]).any((1, 2))
    assert found.mean() > 0.995


def planted(n=6000, d=64, seed=4):
    """Vectors of three labels: strangers, pairs at cosines from 0.9 to 1, groups of 2 to 40, chains, a hub with many links, equal rows."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    rows = list(unit(rng.normal(size=(n, d))))
    away = lambda c, x: x * c + np.sqrt(1 - x * x) * unit((r := rng.normal(size=d)) - (r @ c) * c)
    for x in np.linspace(0.9, 1, 200):
        rows += [c := unit(rng.normal(size=d)), away(c, x)]
    for size in (2, 5, 12, 40):
        for _ in range(4):
            c = unit(rng.normal(size=d))
            rows += [away(c, rng.uniform(0.95, 0.999)) for _ in range(size)]
    c = unit(rng.normal(size=d))
    for _ in range(30):
        rows.append(c := away(c, 0.96))
    hub = unit(rng.normal(size=d))
    rows += [hub] * 7 + [away(hub, 0.94) for _ in range(60)]
    label = rng.integers(0, 3, len(rows) // 10 + 1).repeat(10)[: len(rows)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j].tolist(), int(label[j])) for i, j in enumerate(order)]


def test_planted_links_equal_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    near = (x @ x.T / np.outer(n := np.linalg.norm(x, axis=1), n) >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in E.deduplicated(df).collect()}
    links = sum(r.n_links for r in got.values())
    assert near.sum() > 3000 and links <= near.sum() and links / near.sum() >= 0.99
    low = np.arange(len(rows))
    while ((new := np.minimum(low, np.where(near, low, len(rows)).min(1))) != low).any():
        low = new
    assert np.mean([got[i].component_id == low[i] for i in range(len(rows))]) > 0.995
    assert all(got[i].n_links <= near[i].sum() and got[i].kept == (got[i].component_id == i) for i in range(len(rows)))


def test_candidates_follow_the_number_of_vectors(spark):
    """Candidates a vector don't grow with the label: more rotations make buckets smaller."""
    each = {}
    for n in (10_000, 40_000, 160_000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64)).astype(np.float32)
        turns = spark.range(1).select(E.rotations_of(n, 128)).first()[0]
        got = E.buckets(x[:2000] / np.linalg.norm(x[:2000], axis=1)[:, None], E.PLANS[turns][0], turns, E.PLANS[turns][1], E.SEED)
        own = E.buckets(x / np.linalg.norm(x, axis=1)[:, None], 1, turns, 0, E.SEED)[:, 0, 0]
        names, counts = np.unique(own, return_counts=True)
        at = np.minimum(np.searchsorted(names, got[:, 0]), len(names) - 1)
        each[n] = np.where(names[at] == got[:, 0], counts[at], 0).sum(1).mean() * E.PLANS[turns][0]
    assert max(each.values()) < 400 and each[160_000] < 2 * each[40_000], each


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 16))
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(E.hadamard(x), x @ h / 4) and np.allclose(np.linalg.norm(E.rotated(x, [1, 2, 3]), axis=1), np.linalg.norm(x, axis=1))


def test_sql_on_tables(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.execute(E.OP1_SQL).fetchall())
    assert sorted(tuple(r) for r in E.op1(spark, sf).collect()) == want
