"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, label): every vertex of the edges (a, b) and the smallest vertex it reaches.

    Every round takes the smallest label around each vertex, then follows the labels of labels; rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder, which cuts the lineage.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "v", "left").select("v", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        step = stored(lower, name)
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(jump, "label", "left").select("v", F.least(F.col("label"), F.coalesce("next", "label")).alias("label"), "was"), name)
        if new.where("label <> was").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
