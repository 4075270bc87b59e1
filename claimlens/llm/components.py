"""Connected components of an edge table by label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import Stages


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Each round takes the smallest label among a node and its neighbours, then jumps
    to that label's label; tables are written between rounds, and only a count of
    changes reaches the driver."""
    both = stages.write(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-both")
    labels = stages.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
                          f"{name}-labels0")
    turn = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = step.join(jump, "label", "left").select("node", "old", F.least(F.col("label"), F.col("further")).alias("label"))
        turn += 1
        after = stages.write(after, f"{name}-labels{turn}")
        stages.drop(f"{name}-labels{turn - 1}")
        labels = after.select("node", "label")
        if after.filter("old <> label").isEmpty():
            stages.drop(f"{name}-both")
            return labels
