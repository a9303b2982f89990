"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  v, label: the smallest vertex that each vertex of an edge can reach.

    Each round takes the least label among neighbours and then the label of that label; every round is
    written to the shared folder, and nothing but one count comes to the driver.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")))
    while True:
        around = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around, labels.v == around.a).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("v").alias("_l"), F.col("label").alias("_far"))
        step = stored(step.join(hop, F.col("label") == F.col("_l"), "left").select("v", "was", F.least("label", "_far").alias("label")))
        changed = step.filter("was != label").limit(1).count()
        dropped(labels)
        labels = step
        if not changed:
            dropped(both)
            out = step.select("v", "label")
            out._quillspan_path = step._quillspan_path
            return out
