"""Groups of things that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.kept import stage


def groups(links: DataFrame) -> DataFrame:
    """(node, group) of every node of ``links`` (a, b): the smallest node it is connected with.

    Every round each node takes the smallest label among its neighbours and, through the label's own label, jumps on;
    long chains so shorten by half. Rounds end when no label changes; each is a written table, none comes to the driver.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = stage(both.select(F.col("a").alias("node")).distinct().withColumn("group", F.col("node")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("least"))
        taken = labels.join(near, "node").select("node", F.least("group", "least").alias("group"), F.col("group").alias("was"))
        jump = taken.select(F.col("node").alias("_at"), F.col("group").alias("_to"))
        new = stage(taken.join(jump, F.col("group") == F.col("_at")).select("node", F.least("group", "_to").alias("group"), "was"), "labels")
        if new.filter(F.col("group") != F.col("was")).isEmpty():
            return new.select("node", "group")
        labels = new.select("node", "group")
