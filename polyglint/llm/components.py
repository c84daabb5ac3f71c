"""Connected components by least labels and pointer jumping, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """From undirected edges (a, b): node, label. Equal labels are one component; the label is its least node.

    Each round takes the least label among neighbours, then the label of the label, until nothing
    changes. Labels offered to a node are reduced before they are shuffled. Edges of a node with
    many neighbours meet its label in a join whose partitions adaptive execution splits.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label").checkpoint()
    for _ in range(max_rounds):
        offered = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        own = labels.withColumn("before", F.col("label"))
        least = own.unionByName(offered, allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.min("before").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = least.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")).checkpoint()
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) after adding links (a, b); only links between components are followed."""
    end = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    between = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    if between.isEmpty():
        return labels
    merged = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("further"))
    nodes = labels.union(merged.select(F.col("label").alias("node"), "label")).distinct()  # with nodes that had no links before
    return nodes.join(merged, "label", "left").select("node", F.coalesce("further", "label").alias("label")).distinct().checkpoint()
