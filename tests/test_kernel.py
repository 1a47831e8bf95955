import numpy as np
import pytest

from tessera.operators import dsp


@pytest.fixture
def batches(spark):
    """Sets the rows of a batch to Python, of one partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def set_(n):
        spark.conf.set(key, n)
        return spark

    yield set_
    spark.conf.unset(key)


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("rows", [5, 10_000])
def test_trials_across_batches(batches, monkeypatch, size, rows):
    monkeypatch.setattr(dsp, "ROWS", rows)
    rng = np.random.default_rng(size)
    trials = {(f"s{k}" if k else None, ch): rng.normal(size=n) for k, n in enumerate([20, 64, 16, 7 * 5, 300, 33]) for ch in (0, 2)}
    trials["s2", 2][3] = np.nan
    flat = [(k, t * 3, ch, None if np.isnan(v) else float(v)) for (k, ch), x in trials.items() for t, v in enumerate(x)]
    df = batches(size).createDataFrame([flat[i] for i in rng.permutation(len(flat))], "trial_id string, t int, ch int, x double")
    b, a = dsp.butter(2, [10, 20], "bandpass", 100)
    for got, f, keeps in ((dsp.filter_butter(df, [10, 20], 100), lambda x: dsp.filtfilt(b, a, x), True), (dsp.resample(df, 100, 50), lambda x: dsp.resampled(x, round(len(x) / 2)), False)):
        assert dict(got.dtypes) == {"trial_id": "string", "ch": "int", "t": "bigint", "x": "double"}
        found = {}
        for r in got.collect():
            found.setdefault((r.trial_id, r.ch), []).append((r.t, r.x))
        assert found.keys() == trials.keys()
        for k, x in trials.items():
            want = f(x)
            assert [t for t, _ in sorted(found[k])] == [t * (3 if keeps else 1) for t in range(len(want))]
            assert np.array_equal([v for _, v in sorted(found[k])], want, equal_nan=True), k


def test_many_trials_share_a_batch_and_the_responses(spark):
    df = spark.range(40_000).selectExpr("id div 40 as trial_id", "id % 40 as t", "0 as ch", "sin(id) as x")
    out = dsp.filter_butter(df, [10, 20], 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert out.count() == 40_000
    b, a = dsp.butter(2, [10, 20], "bandpass", 100)
    dsp.responses.cache_clear()
    for _ in range(5):
        dsp.filtfilt(b, a, np.ones(40))
    assert dsp.responses.cache_info().misses == 1
