"""Numbers and texts that are known from elsewhere, not from this package's SQL."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import features, geometry


def test_affine_maps(spark):
    given = [(13.987, 36.5, 10.067), (-10.54, 24.5, 15.555)]
    there = [(14.15310394, 34.73510469, 9.41733728), (-10.60987978, 23.11927315, 14.49010227)]
    df = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x double, y double, z double")
    got = lambda d: [tuple(r)[1:] for r in d.orderBy("id").collect()]
    assert np.allclose(got(geometry.affine(df(given), "to_average")), there, rtol=1e-3)
    assert np.allclose(got(geometry.affine(df(there), "to_mni")), given, rtol=1e-3)


def test_transcripts(spark):
    df = spark.createDataFrame([("Café, it's n\u00f1 \ufb01ne -- 日本 (ok)!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(features.clean_transcript(F.col("t"))).collect()] == ["CAFE IT'S NN FINE   OK", None, ""]


def test_words(spark):
    df = spark.createDataFrame([(1, 1, "b2"), (1, 2, "sp"), (1, 3, "a"), (0, 9, "b"), (2, 0, "c1"), (2, 1, "c")], "f int, l int, token string")
    assert {r.token: r.id for r in features.word_ids(df, "token", "f", "l").collect()} == {"b": 1, "a": 2, "c": 3, "sp": -1}


def test_crops(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 1, 3.0), (0, 2, 8.0), (1, 0, -400.0)], "trial_id int, seq int, onset double")
    got = sorted(tuple(r) for r in features.crop_events(df, 0.5, 1.0, 9.0, 100.0).collect())
    assert got == [(0, 0, 0.0, 4.0), (0, 1, 2.5, 9.0), (0, 2, 7.5, 9.0), (1, 0, -400.5, 9.0)]
