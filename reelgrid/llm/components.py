"""Connected components of an edge table by minimum labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.session import written


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node of `edges` (columns a, b).

    Each round takes the smallest label among a node's neighbours (a partial aggregate, so that a hub is not gathered) and then the
    label of that label; rounds end when no label changes. Labels are written to the shared folder each round.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        lowered = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "low").alias("next"))
        over = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        jumped = lowered.join(over, F.col("next") == F.col("via"), "left").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("changed"))
        labels = written(jumped, "labels")
        if labels.where("changed").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
