"""Recordings and sensors: cuts around aligned regions, label resampling, references between contacts, lags of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.signals import lda_discriminability, segments


def split_on_alignment(signal: DataFrame, regions: DataFrame, fs: float, before: float, after: float, buffer: float = 1.0) -> DataFrame:
    """(trial_id, region, t, x, low, high): samples of each region (trial_id, region, start, stop in seconds) with before, after and a buffer, numbered
    anew; low and high are the buffers that the recording leaves room for. Sample bounds round halves to even. Regions are joined to their
    recording by seconds, so that a sample meets only regions that reach its second."""
    n = signal.groupBy("trial_id").agg((F.max("t") + 1).alias("_n"))
    r = regions.join(n, "trial_id")
    a, z, long = F.col("start") - before, F.col("stop") + after, F.col("_n") / fs
    low, high = F.when(a < buffer, a).otherwise(buffer), F.when(long - z < buffer, long - z).otherwise(buffer)
    first = F.bround(F.when(a < buffer, 0.0).otherwise(a - buffer) * fs).cast("long")
    last = F.least(F.bround(F.when(long - z < buffer, long).otherwise(z + buffer) * fs).cast("long"), F.col("_n"))
    r = r.select("trial_id", "region", low.alias("low"), high.alias("high"), first.alias("_a"), last.alias("_z")).filter("_a < _z")
    second = lambda c: F.floor(c / max(fs, 1.0))
    r = r.withColumn("_s", F.explode(F.sequence(second(F.col("_a")), second(F.col("_z") - 1))))
    s = signal.withColumn("_s", second(F.col("t")))
    met = s.join(r, ["trial_id", "_s"]).filter((F.col("t") >= F.col("_a")) & (F.col("t") < F.col("_z")))
    return met.select("trial_id", "region", (F.col("t") - F.col("_a")).alias("t"), "x", "low", "high")


def remove_buffer(cut: DataFrame, fs: float) -> DataFrame:
    """The rows of split_on_alignment() without their buffers, numbered anew."""
    n = F.count("*").over(Window.partitionBy("trial_id", "region"))
    a, z = F.bround(F.col("low") * fs).cast("long"), F.bround(F.col("high") * fs).cast("long")
    inner = cut.withColumn("_n", n).filter((F.col("t") >= a) & (F.col("t") < F.col("_n") - z))
    return inner.select("trial_id", "region", (F.col("t") - a).alias("t"), "x")


def pad(signal: DataFrame, before: int, after: int) -> DataFrame:
    """(trial_id, t, x) with zeros before and after each trial."""
    n = signal.groupBy("trial_id").agg((F.max("t") + 1).alias("_n"))
    zeros = n.select("trial_id", F.explode(F.concat(F.sequence(F.lit(0), F.lit(before - 1)).cast("array<bigint>") if before else F.array().cast("array<bigint>"), F.transform(F.sequence(F.lit(0), F.lit(after - 1)), lambda i: i + F.col("_n") + before) if after else F.array().cast("array<bigint>"))).alias("t"), F.lit(0.0).alias("x"))
    return signal.select("trial_id", (F.col("t") + before).alias("t"), "x").unionByName(zeros)


def resample_categorical(df: DataFrame, num: int, label: str = "label") -> DataFrame:
    """(trial_id, t, label): labels at num samples a trial; a run from a to b fills round(a num / n) to round(b num / n), halves to even, later runs
    over earlier ones."""
    w = Window.partitionBy("trial_id").orderBy("t")
    n = F.count("*").over(Window.partitionBy("trial_id"))
    starts = df.select("trial_id", "t", F.col(label).alias("label"), F.lag(label).over(w).alias("_p"), n.alias("_n")).filter("_p is null or _p != label")
    place = lambda c: F.bround(c * num / F.col("_n")).cast("long")
    runs = starts.withColumn("_z", place(F.coalesce(F.lead("t").over(w), F.col("_n")))).withColumn("_a", place(F.col("t"))).filter("_a < _z")
    at = runs.select("trial_id", "t", "label", F.explode(F.sequence("_a", F.col("_z") - 1)).alias("_t"))
    return at.groupBy("trial_id", F.col("_t").alias("t")).agg(F.max_by("label", F.col("t")).alias("label"))


def join_time(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each trial's samples of first, then those of second; trials that both have."""
    n = first.groupBy("trial_id").agg((F.max("t") + 1).alias("_n"))
    later = second.join(n, "trial_id").select("trial_id", (F.col("t") + F.col("_n")).alias("t"), "x")
    return first.join(second.select("trial_id").distinct(), "trial_id", "left_semi").select("trial_id", "t", "x").unionByName(later)


def join_channels(first: DataFrame, second: DataFrame, channels: int) -> DataFrame:
    """Rows (trial_id, t, ch, x) of first, which has so many channels, and of second with channels after them; samples that both have."""
    both = lambda a, b: a.join(b.select("trial_id", "t").distinct(), ["trial_id", "t"], "left_semi").select("trial_id", "t", "ch", "x")
    return both(first, second).unionByName(both(second, first).withColumn("ch", F.col("ch") + channels))


def contacts(names: Column) -> tuple[Column, Column]:
    """The contact that a channel's name starts with, and its number there."""
    return F.regexp_replace(names, "[0-9]+$", ""), F.regexp_extract(names, "([0-9]+)$", 1).cast("long")


def local_reference(channels: DataFrame, extent: int = 1) -> DataFrame:
    """(ch, ref): of channels (ch, name) those on the same shank whose number differs by extent at most, without itself."""
    if extent < 1:
        raise ValueError("extent must be 1 at least")
    stem, number = contacts(F.col("name"))
    c = channels.select("ch", stem.alias("stem"), number.alias("number"))
    near = F.explode(F.expr(f"filter(sequence(-{extent}, {extent}), d -> d != 0)"))
    asks = c.select("ch", "stem", near.alias("_d"), "number").select("ch", "stem", (F.col("number") + F.col("_d")).alias("number"))
    return asks.join(c.withColumnRenamed("ch", "ref"), ["stem", "number"]).select("ch", "ref")


def common_reference(df: DataFrame, channels: DataFrame, kind: str = "avg") -> DataFrame:
    """(trial_id, t, ch, x) less the mean (or median) of the channels on the same contact at that time, itself among them."""
    stem, _ = contacts(F.col("name"))
    named = df.join(F.broadcast(channels.select("ch", stem.alias("_stem"))), "ch")  # one row a channel
    f = F.avg if kind == "avg" else F.median
    return named.withColumn("x", F.col("x") - f("x").over(Window.partitionBy("trial_id", "t", "_stem"))).drop("_stem")


def electrode_lags(df: DataFrame, most: int = 20) -> DataFrame:
    """(ch, lag): where each channel's discriminability after label changes, smoothed (Gaussian of deviation 0.5, five taps, zeros outside), is
    greatest; the first at ties. df: (trial_id, t, ch, x, label)."""
    flat = df.withColumn("trial_id", F.struct("trial_id", "ch"))
    cut = segments(flat, 0, most).select(F.col("trial_id.ch").alias("ch"), "i", "x", "label")
    f = lda_discriminability(cut, ("ch", "i"))
    g = [float(2.718281828459045 ** (-0.5 * (k / 0.5) ** 2)) for k in (-2, -1, 0, 1, 2)]
    w = Window.partitionBy("ch").orderBy("i")
    smooth = sum((F.coalesce(F.lag("f", -k).over(w) if k <= 0 else F.lead("f", k).over(w), F.lit(0.0)) * (v / sum(g)) for k, v in zip((-2, -1, 0, 1, 2), g)), F.lit(0.0))
    s = f.withColumn("s", smooth)
    return s.groupBy("ch").agg(F.max(F.struct("s", (-F.col("i")).alias("i"))).alias("m")).select("ch", (-F.col("m.i")).alias("lag"))
