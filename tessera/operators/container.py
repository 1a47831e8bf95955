"""Trials as rows: projection, selection, mutation and set operations. trial_id numbers the trials from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.grains import numbered


def sliced(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Trials of a slice with a positive step, numbered anew. Negative ends count from the last."""
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 else 0
    a = max(0, n + start) if (start or 0) < 0 else start or 0
    z = n + stop if (stop or 0) < 0 else stop
    t = F.col("trial_id")
    out = df.filter((t >= a) & ((t - a) % step == 0))
    return (out if z is None else out.filter(t < z)).withColumn("trial_id", F.floor((t - a) / step).cast("long"))


def take(df: DataFrame, positions: list[int]) -> DataFrame:
    """Trials by position, in that order and as often as named."""
    at = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(positions)], "_new long, trial_id long")
    return df.join(F.broadcast(at), "trial_id").withColumn("trial_id", F.col("_new")).drop("_new")


def delete_trial(df: DataFrame, i: int) -> DataFrame:
    t = F.col("trial_id")
    return df.filter(t != i).withColumn("trial_id", t - F.when(t > i, 1).otherwise(0))


def replace_trial(df: DataFrame, trial: DataFrame, i: int) -> DataFrame:
    """Trial i becomes the row of trial; one past the last is appended, further is an error."""
    if i > df.count():
        raise IndexError(i)
    return df.filter(F.col("trial_id") != i).unionByName(trial.withColumn("trial_id", F.lit(i).cast("long")), allowMissingColumns=True)


def concat_trials(frames: list[DataFrame]) -> DataFrame:
    """All trials after one another, with the fields that all have, in the first one's order."""
    shared = [c for c in frames[0].columns if c != "trial_id" and all(c in f.columns for f in frames)]
    offset, parts = 0, []
    for f in frames:
        parts.append(f.select((F.col("trial_id") + offset).alias("trial_id"), *shared))
        offset += f.count()
    return reduce(DataFrame.unionByName, parts)


def concat_fields(frames: list[DataFrame]) -> DataFrame:
    """Fields side by side by position; lengths must agree, the first holder of a name wins."""
    if len({f.count() for f in frames}) > 1:
        raise ValueError("the lengths differ")
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select("trial_id", *[c for c in f.columns if c not in out.columns]), "trial_id")
    return out


def append(df: DataFrame, trial: DataFrame, strict: bool = True) -> DataFrame:
    return df.unionByName(trial.withColumn("trial_id", F.lit(df.count()).cast("long")), allowMissingColumns=not strict)


def created(rows: DataFrame, *order: str) -> DataFrame:
    """A container of the rows, numbered in the given order."""
    return numbered(rows, *order)
