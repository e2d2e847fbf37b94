"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged


def connected_components(edges: DataFrame, staged: Staged) -> DataFrame:
    """node, comp for every node of edges (a, b); comp is its component's smallest node.

    Each round takes the smallest label of a node's neighbours (with partial minima, as a node can have
    very many) and then the label of that label, until no label changes.
    """
    both = staged.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = staged.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select("node", "comp", F.least("comp", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        following = staged.write(nearer.join(jump, "near", "left").select("node", F.least("near", "far").alias("comp"), (F.least("near", "far") < F.col("comp")).alias("moved")))
        labels = following.select("node", "comp")
        if following.where("moved").isEmpty():
            return labels
