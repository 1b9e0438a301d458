"""Connected components by repeated contraction: every round each node merges into its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node that can be reached.

    A round maps each node to the smallest of itself and its neighbours, then draws the edges between what they were
    mapped to. Only local minima remain, at most half of a component's nodes, so rounds are logarithmic and edges shrink.
    Each round is written to the shared folder; no edge or label reaches the driver.
    """
    left = keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "edges")
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    while left.take(1):
        both = left.union(left.select("v", "u"))
        to = keep(both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("v")).select("at", F.least("at", "v").alias("to")), "hooks")
        labels = keep(labels.join(to, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = left.join(to.select(F.col("at").alias("u"), F.col("to").alias("x")), "u").join(to.select(F.col("at").alias("v"), F.col("to").alias("y")), "v")
        left = keep(left.select(F.col("x").alias("u"), F.col("y").alias("v")).filter("u <> v").distinct(), "edges")
    return labels
