"""Joins over paths: what lies under a folder, and the folder that owns a path, as equi-joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.expressions import ancestors


def under(rows: DataFrame, folders: DataFrame, on: list[str] = ()) -> DataFrame:
    """Each of ``rows`` (rel_path) with each of ``folders`` (folder) that is it or lies above it.

    A path has as many ancestors as it has parts, so rows grow by their depth and no pair is tried in vain.
    """
    return rows.withColumn("folder", F.explode(ancestors("rel_path"))).join(folders, [*on, "folder"])


def counts_under(rows: DataFrame, folders: DataFrame, on: list[str] = ()) -> DataFrame:
    """How many of ``rows`` lie under each folder, zero included."""
    n = under(rows, folders, on).groupBy(*on, "folder").agg(F.count("*").alias("n"))
    return folders.join(n, [*on, "folder"], "left").select(*on, "folder", F.coalesce("n", F.lit(0)).alias("n"))


def owner(rows: DataFrame, folders: DataFrame, on: list[str] = ()) -> DataFrame:
    """Each path with the longest folder above it."""
    return under(rows, folders, on).groupBy(*on, "rel_path").agg(F.max_by("folder", F.length("folder")).alias("owner"))
