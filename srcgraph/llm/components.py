"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of the component.

    Least labels flow along edges, combined before each shuffle, and then jump to the label of the
    label, so that long chains shorten quickly. Each round is checkpointed.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        merged = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        target = merged.select(F.col("node").alias("_of"), F.col("label").alias("_next"))
        jumped = merged.join(target, F.col("label") == F.col("_of"), "left").select(
            "node", F.least("label", F.coalesce("_next", "label")).alias("label"), "was"
        )
        step = cut_lineage(jumped)
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels
