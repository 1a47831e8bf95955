import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import recording


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast unasked."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.unset(key)


@pytest.mark.parametrize("kind", ["avg", "med"])
def test_common_reference_spreads_over_tasks(large, kind):
    spark = large
    names = spark.createDataFrame([(0, "LT1"), (1, "LT2"), (2, "RA1"), (4, "LT3"), (9, "GA1")], "ch int, name string")
    df = spark.range(12_000).select((F.col("id") % 4).alias("trial_id"), F.expr("id div 20").alias("t"), F.expr("cast(id div 4 % 5 as int)").alias("ch"), F.sin("id").alias("x"))
    out = recording.common_reference(df, names, kind)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # rows don't meet by channel: there are few channels
    rows = out.collect()
    x = {(i % 4, i // 20, i // 4 % 5): np.sin(i) for i in range(12_000)}
    f = np.mean if kind == "avg" else np.median
    assert len(rows) == 12_000 * 4 // 5  # channel 3 has no name
    for r in rows:
        same = [2] if r.ch == 2 else [0, 1, 4]
        assert abs(r.x - (x[r.trial_id, r.t, r.ch] - f([x[r.trial_id, r.t, c] for c in same]))) < 1e-12
