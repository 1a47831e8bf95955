import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import signals


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def expected(p, negative):
    """Adjusted p of numbers without nulls."""
    m, order = len(p), np.argsort(p, kind="stable")
    q = p[order] * m / np.arange(1, m + 1) * (np.sum(1 / np.arange(1, m + 1)) if negative else 1)
    out = np.empty(m)
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


@pytest.mark.parametrize("negative", [False, True])
def test_large_family_is_ranked_in_many_tasks(apart, negative):
    n = 40_000
    p = np.random.default_rng(1).beta(0.3, 4, n).round(4)  # many ties
    df = apart.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id long, p double")
    out = signals.fdr(df, negative=negative).withColumn("task", F.spark_partition_id()).collect()
    assert out[0].asDict().keys() == {"id", "p", "q", "task"} and len(out) == n
    assert np.allclose([r.q for r in sorted(out)], expected(p, negative), rtol=1e-12, atol=0)
    assert np.bincount([r.task for r in out]).max() < n / 2


def test_equal_p_do_not_meet_in_one_task(apart):
    out = signals.fdr(apart.range(20_000).withColumn("p", F.lit(0.25)), negative=True).withColumn("task", F.spark_partition_id()).collect()
    assert {r.q for r in out} == {1.0} and np.bincount([r.task for r in out]).max() < 20_000 / 2


def test_sum_of_reciprocals(spark):
    ms = [1, 2, 999, 1000, 1001, 50_000, 3_000_000]
    got = spark.createDataFrame([(m,) for m in ms], "m long").select("m", signals.harmonic(F.col("m")).alias("h")).collect()
    assert np.allclose([r.h for r in sorted(got)], [np.sum(1 / np.arange(1, m + 1)) for m in ms], rtol=1e-14, atol=0)


def test_families_nulls_and_nan_equal_sql(apart):
    rng = np.random.default_rng(2)
    rows = [(i, f, None if rng.random() < 0.1 else float(rng.choice([0.001, 0.01, 0.02, rng.random(), np.nan], p=[0.1, 0.1, 0.1, 0.65, 0.05]))) for i, f in enumerate(rng.choice(["a", "b", "c", None], 600, p=[0.6, 0.3, 0.05, 0.05]).tolist())]
    c = duckdb.connect()
    c.execute("create table p_ (id bigint, f varchar, p double)")
    c.executemany("insert into p_ values (?, ?, ?)", rows)
    sql = """with r as (select *, row_number() over (partition by f order by p, id) as k, count(*) over (partition by f) as m from p_), q as (select *, p * m / k as q0 from r)
    select id, least(min(q0) over (partition by f order by k rows between current row and unbounded following), 1) as q from q order by id"""
    got = signals.fdr(apart.createDataFrame(rows, "id long, f string, p double"), by=("f",)).select("id", "q").orderBy("id").collect()
    want = c.execute(sql).fetchall()
    assert [r.id for r in got] == [w[0] for w in want] and np.allclose([r.q for r in got], [w[1] for w in want], rtol=1e-12, atol=0)


def test_empty(spark):
    assert signals.fdr(spark.createDataFrame([], "id long, p double"), negative=True).count() == 0
