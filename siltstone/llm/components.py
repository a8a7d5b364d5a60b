"""Connected components of a link table by minimum labels and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest node it can reach.

    Each round takes the smallest label among a node and its neighbours, then follows the label's
    own label, so long chains shrink geometrically. Neighbour minima combine before the shuffle, and
    joins have one label row per node, which adaptive execution splits for hot nodes. Every round is
    written to shared storage, so lineage stays short. An empty link table gives an empty result.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    both = materialise(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = lower.join(above, "root").select("node", F.least("root", "top").alias("root"), "old")
        step = materialise(jumped, "labels")
        labels = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return labels
