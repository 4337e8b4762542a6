"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is one node of the component.

    Each round every node points to its smallest neighbour that is smaller than itself, pointers
    are doubled until they reach a root, and the links are carried over to the roots. A round at
    least halves the nodes that still have links, so rounds grow with the logarithm of the graph.
    Links of a node are only aggregated, never gathered.
    """
    links = cut_lineage(links.select("a", "b").filter("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = cut_lineage(nodes.withColumn("label", F.col("node")))
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        up = cut_lineage(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("up"))
            .select("node", F.least("node", "up").alias("up"))
        )
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            doubled = cut_lineage(
                up.join(above, "up").select("node", F.col("top").alias("up"), "top", F.col("up").alias("was"))
            )
            moved = doubled.filter("up <> was").limit(1).count()
            up = doubled.select("node", "up")
            if not moved:
                break
        labels = cut_lineage(
            labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select(
                "node", F.coalesce("up", "label").alias("label")
            )
        )
        links = cut_lineage(
            links.join(up.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    return labels
