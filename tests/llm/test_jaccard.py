import random
import time

import duckdb
import pytest

from tessera.llm import graph, jaccard_join as J

rng = random.Random(3)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 90 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), len(near[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(n=120):
    words = [f"w{i}" for i in range(400)]
    hot = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 8, 40, 150]))]
        if rng.random() < 0.4:
            base += hot
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rng.shuffle(rows)
    out = [(i, (" " if i % 3 else "\n").join(x).upper() if i % 7 == 0 else " ".join(x)) for i, x in enumerate(rows)]
    return out + [(None, None), (-5, ""), (-6, " \t"), (3, out[3][1]), (None, out[4][1]), (-7, "é   É"), (-8, "one"), (-9, "ONE"), (-10, "x y z w v " * 3000)]


@pytest.mark.parametrize("region", [256, 4])
def test_equals_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(J, "REGION", region)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in J.joined(df).collect()), key=str)
    want = brute(rows)
    assert got == want and sum(r[2] > 0 for r in want) > 100
    assert J.joined(df.limit(0)).count() == 0


def test_a_chain_and_shared_boilerplate(spark, monkeypatch):
    """One component that a long chain of near copies makes, and hundreds of sets that share most of their words but don't link."""
    monkeypatch.setattr(J, "REGION", 16)
    words = [f"c{i}" for i in range(1200)]
    chain = [words[4 * i : 4 * i + 200] for i in range(150)]
    plate = [f"p{i}" for i in range(160)]
    shared = [plate + [f"u{i}-{j}" for j in range(30)] for i in range(300)] + [plate + [f"v{i}" for i in range(8)] + [f"t{j}"] * (j % 2) for j in range(60)]
    rows = [(i, " ".join(x)) for i, x in enumerate(chain + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in J.joined(df).collect()), key=str)
    want = brute(rows)
    assert got == want and sum(r[3] == 0 for r in want) == 150 and sum(r[2] == 0 for r in want) >= 300


def test_hot_order_changes_nothing(spark, monkeypatch):
    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "HOT_LOCAL", 1)
    assert sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in J.joined(df).collect()), key=str) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50)] + [(60, 60 + i) for i in range(1, 20)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.label for r in graph.components(df).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[41] == got[40] == 40 and got[50] == 50 and got[79] == 60
    assert graph.components(df.limit(0)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    t = time.time()
    want = sorted(con.execute(J.OP10_SQL).fetchall())
    assert time.time() - t < 60
    assert sorted(tuple(r) for r in J.op10(spark, sf).collect()) == want
