"""Connected groups of a link table by least label, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.session import cut_lineage


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is the least node it reaches.

    Each round takes the least label among neighbours and then that label's own label, so long chains halve. A round
    is written to the shared folder; the loop ends when a round changes nothing.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = low.join(jump, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("old")).alias("moved"))
        done = cut_lineage(step)
        labels = done.select("node", "component")
        if done.filter("moved").isEmpty():
            return labels
