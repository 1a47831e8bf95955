import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dsp


def signal(spark, trials, fs=None):
    return spark.createDataFrame([(k, t, 0, float(v)) for k, x in enumerate(trials) for t, v in enumerate(x)], "trial_id long, t long, ch int, x double")


def back(df, n, *names):
    rows = df.orderBy("trial_id", "t").collect()
    return [np.array([[getattr(r, k) for k in names] for r in rows if r.trial_id == i]) for i in range(n)]


def test_butter_golden_coefficients():
    b, a = dsp.butter(2, [10, 20], "bandpass", 100)
    assert np.allclose(b, [0.06745527, 0.0, -0.13491055, 0.0, 0.06745527]) and np.allclose(a, [1.0, -1.94246878, 2.1192024, -1.21665164, 0.4128016])
    gain = lambda b, a, f: abs(np.polyval(b[::-1], z := np.exp(-2j * np.pi * f / 100)) / np.polyval(a[::-1], z))
    for kind, band, passed, stopped, corner in (("lowpass", 10, 0, 50, 10), ("highpass", 10, 50, 0, 10), ("bandstop", [10, 20], 0, np.sqrt(0), 10)):
        b, a = dsp.butter(3, band, kind, 100)
        assert np.isclose(gain(b, a, passed), 1) and np.isclose(gain(b, a, corner), math.sqrt(0.5)) and (np.abs(np.roots(a)) < 1).all()
        if kind != "bandstop":
            assert gain(b, a, stopped) < 1e-6
    with pytest.raises(ValueError):
        dsp.butter(2, 60, "lowpass", 100)
    with pytest.raises(ValueError):
        dsp.butter(2, 10, "bandpass", 100)


def slow(b, a, x, z):
    z, out = list(z), []
    for v in x:
        y = b[0] * v + z[0]
        z = [b[i + 1] * v + (z[i + 1] if i + 1 < len(z) else 0) - a[i + 1] * y for i in range(len(z))]
        out.append(y)
    return np.array(out)


def test_recursive_filter_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    b, a = dsp.butter(2, [10, 20], "bandpass", 100)
    for n in (1, 255, 256, 700):
        x, z = rng.normal(size=n), rng.normal(size=4)
        assert np.allclose(dsp.lfilter(b, a, x, z), slow(b, a, x, z))
    trials = [np.sin(2 * np.pi * 15 * np.arange(600) / 100) + 5, rng.normal(size=300)]
    got = back(dsp.filter_butter(signal(spark, trials), [10, 20], 100), 2, "x")
    assert np.abs(got[0][100:-100, 0] - (trials[0][100:-100] - 5)).max() < 0.15 and len(got[1]) == 300
    with pytest.raises(Exception, match="more than 15"):
        dsp.filter_butter(signal(spark, [np.ones(15)]), [10, 20], 100).collect()
    assert dsp.filter_butter(signal(spark, trials).limit(0), [10, 20], 100).count() == 0


def test_line_noise_goes(spark):
    t = np.arange(2000) / 500
    noise = np.random.default_rng(2).normal(size=2000)
    hum = 3 * np.sin(2 * np.pi * 60 * t) + np.sin(2 * np.pi * 120 * t)
    got = back(dsp.filter_line_noise(signal(spark, [noise + hum]), 500), 1, "x")[0][:, 0]
    spectrum = lambda x: np.abs(np.fft.rfft(x * np.hanning(len(x))))
    assert spectrum(got)[240] < 0.15 * spectrum(noise + hum)[240] and np.corrcoef(got[500:-500], noise[500:-500])[0, 1] > 0.9
    want = noise + hum
    for f in (60, 120, 180, 240):
        want = np.convolve(want, dsp.notch_taps(f, 500, 501))[500:2500]
    assert np.allclose(got, want)
    h = dsp.notch_taps(60, 500, 101)
    x = np.random.default_rng(3).normal(size=50)
    assert np.allclose(dsp.same(x, h), np.convolve(x, h)[100:150])


def test_hilbert_bands(spark):
    t = np.arange(1000) / 500
    x = 2 * np.sin(2 * np.pi * 80 * t)
    rows = dsp.filter_hilbert(signal(spark, [x]), 500, [(8.0, 13.0), (70.0, 150.0)]).groupBy("band").agg(F.avg("amp").alias("a")).collect()
    amp = {r.band: r.a for r in rows}
    assert amp[1] > 20 * amp[0]
    bank = dsp.filterbank_hilbert(signal(spark, [x]), 500, (70.0, 150.0)).groupBy("cf").agg(F.avg("amp").alias("a")).collect()
    best = max(bank, key=lambda r: r.a)
    assert abs(best.cf - 80) < 5 and abs(best.a - 2) < 0.3 and len(bank) == len(dsp.centers([(70.0, 150.0)])[0])
    out = dsp.phase_amplitude(signal(spark, [x]), 500, {"low": (8.0, 13.0), "high": (70.0, 150.0)}, 100)
    assert out.count() == 400 and {r.band for r in out.select("band").distinct().collect()} == {"low", "high"}
    with pytest.raises(ValueError):
        dsp.centers([(100.0, 100.5)])


def test_resampling(spark):
    t = np.arange(200)
    x = np.sin(2 * np.pi * 3 * t / 200) + 0.5 * np.cos(2 * np.pi * 7 * t / 200)
    for n in (50, 51, 199, 200, 400, 401):
        at = np.arange(n) * 200 / n
        assert np.allclose(dsp.resampled(x, n), np.sin(2 * np.pi * 3 * at / 200) + 0.5 * np.cos(2 * np.pi * 7 * at / 200))
    got = back(dsp.resample(signal(spark, [x, x[:100]]), 100, 50), 2, "x", "t")
    assert [len(g) for g in got] == [100, 50] and np.allclose(got[0][:, 0], dsp.resampled(x, 100)) and got[1][-1, 1] == 49
