"""Connected components by least labels and pointer jumping, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> a written table (node, comp): the smallest node reachable, for every node of an edge.

    Each round sends labels along all edges and lets every node take its label's label, so rounds grow with the
    logarithm of the longest chain. Joins read written tables on both sides, which lets Spark split a hub's rows.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")))
    total = lambda df: df.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
    now = total(labels)
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("comp").alias("least"))
        near = checkpoint(labels.join(sent, labels["node"] == sent["to"]).select("node", F.least("comp", "least").alias("comp")))
        up = near.select(F.col("node").alias("__up"), F.col("comp").alias("__top"))
        labels = checkpoint(near.join(up, near["comp"] == up["__up"]).select("node", F.least("comp", "__top").alias("comp")))
        before, now = now, total(labels)
        if now == before:
            return labels
