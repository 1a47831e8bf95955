"""Grains: trials (a row each), and long signals (trial_id, t, ch, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir


def numbered(df: DataFrame, *order: str, name: str = "trial_id") -> DataFrame:
    """df with consecutive numbers from 0 in the given order, without sorting in one task: ranges are sorted apart, and each
    adds the sizes of the ranges before it (one small number a partition)."""
    shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row a partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += sizes[p]
    if not starts:
        return ranged.drop("_range").withColumn(name, F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn(name, F.row_number().over(w) - 1 + F.create_map(*starts)[F.col("_range")]).drop("_range")


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as two-channel signals: (trial_id, t, x, k, label); label is the alphabetical code of the event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = ["click", "error", "purchase", "signup", "view"]
    code = F.create_map(*[v for i, k in enumerate(kinds) for v in (F.lit(k), F.lit(i))])
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("trial_id"), t.cast("long").alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("k"), code[F.col("event_type")].cast("long").alias("label"))
