"""Label vectors from intervals, word lists, transcripts, folds."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_ascii(c: pd.Series) -> pd.Series:
    return c.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def clean_transcript(c: Column) -> Column:
    """Upper case without ASCII punctuation other than the apostrophe; letters with marks lose them, what else isn't ASCII goes."""
    return F.pandas_udf(to_ascii, T.StringType())(F.upper(F.regexp_replace(c, r"[!-&(-/:-@\[-`{-~]", "")))


def word_ids(df: DataFrame, token: str, *order: str) -> DataFrame:
    """(token, id): tokens without digits, numbered from 1 by first appearance; 'sp' is -1."""
    from tessera.operators.grains import numbered

    bare = df.withColumn(token, F.regexp_replace(token, "[0-9]", ""))
    first = bare.groupBy(token).agg(F.min(F.struct(*order)).alias("_f"))
    flat = first.filter(F.col(token) != "sp").select(token, *[F.col(f"_f.{o}").alias(o) for o in order])
    words = numbered(flat, *order, token, name="id").select(token, (F.col("id") + 1).alias("id"))
    return words.unionByName(first.filter(F.col(token) == "sp").select(token, F.lit(-1).cast("long").alias("id")))


def label_vector(intervals: DataFrame, fs: float, before: float = 0.0) -> DataFrame:
    """(trial_id, t, label): samples of [round((start + before) fs), round((end + before) fs)), later rows over earlier ones."""
    a, z = (F.bround((F.col(c) + before) * fs).cast("long") for c in ("start", "end"))
    at = intervals.filter(z > a).select("trial_id", "seq", "label", F.explode(F.sequence(a, z - 1)).alias("t"))
    return at.groupBy("trial_id", "t").agg(F.max(F.struct("seq", "label")).alias("m")).select("trial_id", "t", "m.label")


def kfold(df: DataFrame, k: int) -> DataFrame:
    """(trial_id, fold): contiguous folds over trials numbered from 0, the first n mod k of them one longer."""
    n = df.count()
    if k > n:
        raise ValueError("more folds than trials")
    size, longer, t = n // k, n % k, F.col("trial_id")
    cut = longer * (size + 1)
    return df.select("trial_id", F.when(t < cut, F.floor(t / (size + 1))).otherwise(longer + F.floor((t - cut) / size)).cast("long").alias("fold"))


def sanitize(c: Column) -> Column:
    """Field names without spaces and hyphens."""
    return F.translate(c, " -", "__")


def crop_events(events: DataFrame, before: float, after: float, end: float, fs: float) -> DataFrame:
    """(trial_id, seq, start, stop): from each onset to the next one and after, within the recording; starts less than half the sampling rate
    (in seconds, as numbers) below 0 are 0."""
    nxt = F.lead("onset").over(Window.partitionBy("trial_id").orderBy("seq"))
    start = F.col("onset") - before
    start = F.when((start < 0) & (start > -fs / 2), 0.0).otherwise(start)
    return events.select("trial_id", "seq", start.alias("start"), F.least(F.coalesce(nxt + after, F.lit(end)), F.lit(end)).alias("stop"))
