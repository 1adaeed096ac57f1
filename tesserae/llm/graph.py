"""Connected components of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node with a link.

    Each round takes the smallest label among neighbours and then the label's label, so stars take
    two rounds and chains a logarithmic number. Rounds are tables in the shared folder. A hub's
    links are summed before the shuffle, and where they are joined, adaptive execution splits them."""
    links = links.select("a", "b").where("a != b")
    edges = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("up"))
        after = keep(stepped.join(up, "new").select("node", "old", F.least("new", "up").alias("component")), "labels")
        forget(labels)
        labels = after.select("node", "component")
        if after.where("old != component").isEmpty():
            forget(edges)
            return labels
