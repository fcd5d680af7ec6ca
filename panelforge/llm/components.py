"""Connected components of a table of links, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, so long chains shrink by halves.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_of"))
        after = stored(lower.join(jump, F.col("_new") == F.col("_at"), "left").select("node", "_old", F.least(F.col("_new"), F.coalesce("_of", "_new")).alias("label")))
        labels = after.select("node", "label")
        if after.where("_old <> label").isEmpty():
            return labels
