"""Connected components by smallest label, with tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """Rows (v, label) of each vertex of links (a, b): label is the smallest vertex that links reach from v.

    Each round takes the smallest label of a vertex's neighbours (aggregated before the shuffle, so that vertices with
    many links do no harm) and then the label of its label, until nothing changes. Links may repeat, in either direction,
    and may go from a vertex to itself; an empty table has no vertices."""
    both = written(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("m"))
        step = labels.join(near, "v").select("v", F.col("label").alias("before"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        out = written(step.join(jump, "label").select("v", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("before")).alias("moved")), "labels")
        labels = out.select("v", "label")
        if out.filter("moved").isEmpty():
            return labels
