"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is
    named by its smallest node.

    Each round a node takes the least label around it, then the label of that
    label, so paths halve; rounds go on until no label changes.  Every round is
    checkpointed: a lost executor costs one round at most."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = cut_lineage(both)
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")) \
        .withColumnRenamed("a", "node")
    labels = cut_lineage(labels)
    while True:
        around = (both.join(labels.withColumnRenamed("node", "b"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(hop, "label").select("node", "old", F.least("label", "further").alias("label"))
        moved = cut_lineage(moved)
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
