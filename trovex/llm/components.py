"""Connected components of an edge table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.runtime import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached from each node of ``edges`` (a long, b long).

    Each round, a node takes the smallest label among its neighbours' and its own, and then the label of that label.
    Rounds end when no label changes; their number grows with the logarithm of a component's width. Each round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        hop = labels.join(near.hint("merge"), labels["node"] == near["n"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("parent"), F.col("label").alias("grand"))
        jumped = hop.join(up.hint("merge"), hop["label"] == up["parent"], "left").select("node", "old", F.least("label", F.coalesce("grand", "label")).alias("label"))
        jumped = materialize(jumped)
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            return labels
