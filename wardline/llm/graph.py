"""Connected components of links that are never brought to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that label. Minima are merged
    before the shuffle, and the joins are plain ones that adaptive execution can split where one node has most links.
    """
    both = links.select("a", "b").where("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")
    ), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("offered")
        )
        lower = labels.join(offered, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "offered").alias("component")
        )
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = stored(lower.join(jump, "component").select("node", "before", F.col("further").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("before <> component").isEmpty():
            return labels
