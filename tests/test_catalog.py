"""Every query of the catalog against its SQL."""

import math

import duckdb
import pytest

from tessera.plans import catalog, extra  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (float, int)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(cur.fetchall(), key=str)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert len(got) == len(want) > 0
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w)), next((g, w) for g, w in zip(got, want) if not all(map(same, g, w)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())
