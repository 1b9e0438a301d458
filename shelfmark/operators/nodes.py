"""Virtual nodes: what a library shows at its top, gathered over all roots, with how many records each holds at any depth.

A folder at the top of a root belongs to the artist whose key is the longest run of whole words that its name's key
begins with; folders of one artist are one node, any other folder is a node of its own. Words meet keys by equality on
exploded prefixes, and records are counted under all folders above them in one aggregate, so nodes are neither compared
with folders nor asked one by one. Where no record lies, no node is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.expressions import ancestors, col, nocase_key
from shelfmark.functions.names import artist_name


def word_prefixes(key) -> F.Column:
    """``a b c`` as ``a``, ``a b``, ``a b c``."""
    words = F.split(col(key), " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))


def owned(names: DataFrame, name: str, artists: DataFrame) -> DataFrame:
    """The distinct ``names`` with ``owner``, the longest key of ``artists`` (key) that the name's key is or goes on from; null where none."""
    keyed = names.select(name).distinct().withColumn("_key", artist_name(name)["key"])
    met = keyed.filter("_key <> ''").select(name, F.explode(word_prefixes("_key")).alias("key")).join(artists.select("key").distinct(), "key")
    longest = met.groupBy(name).agg(F.max_by("key", F.length("key")).alias("owner"))
    return keyed.select(name).join(longest, name, "left")


def record_counts(records: DataFrame) -> DataFrame:
    """(root_id, rel_path, records) of every folder at or under which ``records`` (root_id, rel_path) lie."""
    return records.select("root_id", F.explode(ancestors("rel_path")).alias("rel_path")).groupBy("root_id", "rel_path").agg(F.count("*").alias("records"))


def tops(tree: DataFrame, artists: DataFrame) -> DataFrame:
    """(root_id, top, owner, node) of the folders at the top of each root that are not empty; ``node`` is the artist's key or the folder's own place."""
    top = tree.filter("parent = '' AND role <> 'empty'").select("root_id", F.col("rel_path").alias("top"))
    named = top.join(owned(top, "top", artists), "top")
    own = F.concat(F.lit("/"), F.col("root_id").cast("string"), F.lit("/"), F.col("top"))
    return named.select("root_id", "top", "owner", F.coalesce("owner", own).alias("node"))


def virtual_nodes(tree: DataFrame, records: DataFrame, artists: DataFrame) -> DataFrame:
    """(node, artist_id, name, sort, folders, records) of the nodes that hold records. ``artists`` has key, id, name, sort_key."""
    n = record_counts(records).filter(~F.col("rel_path").contains("/")).withColumnRenamed("rel_path", "top")
    held = tops(tree, artists).join(n, ["root_id", "top"]).groupBy("node", "owner")
    folder = F.struct("root_id", "top")
    nodes = held.agg(F.sum("records").alias("records"), F.count("*").alias("folders"), F.min(folder).alias("first"))
    a = artists.groupBy(F.col("key").alias("owner")).agg(F.min(F.struct("id", "name", "sort_key")).alias("a"))
    name, sort = F.coalesce("a.name", "first.top"), F.coalesce("a.sort_key", "a.name", "first.top")
    return nodes.join(a, "owner", "left").select("node", F.col("a.id").alias("artist_id"), name.alias("name"), sort.alias("sort"), "folders", "records")


def nested(tree: DataFrame, records: DataFrame, artists: DataFrame) -> DataFrame:
    """(node, root_id, rel_path, depth, is_record, records): every folder at any depth inside a node, with the records at or under it.

    Discs and what else lies inside a record are not listed: the record stands for them.
    """
    known = records.select("root_id", "rel_path", F.lit(True).alias("is_record")).distinct()
    counted = record_counts(records).join(known, ["root_id", "rel_path"], "left")
    top = F.substring_index("rel_path", "/", 1)
    placed = counted.withColumn("top", top).join(tops(tree, artists).select("root_id", "top", "node"), ["root_id", "top"])
    depth = F.size(F.split("rel_path", "/"))
    return placed.select("node", "root_id", "rel_path", depth.alias("depth"), F.coalesce("is_record", F.lit(False)).alias("is_record"), "records")


def library(records: DataFrame, tree: DataFrame, artists: DataFrame) -> DataFrame:
    """``records`` with the node each lies under; those under none are absent."""
    place = tops(tree, artists).select("root_id", "top", "node")
    return records.withColumn("top", F.substring_index("rel_path", "/", 1)).join(place, ["root_id", "top"]).drop("top")


def drawers(listed: DataFrame) -> DataFrame:
    """Which drawer each record of ``listed`` (node, root_id, rel_path, direct, artist_id, artist) lies in, by credit.

    A node is sorted into drawers if it shows records alone (all ``direct``), all are credited, and to more than one key.
    The briefest spelling, the first of equals, names a drawer.
    """
    key = artist_name("artist")["key"]
    rows = listed.withColumn("key", F.when(F.col("artist_id").isNotNull(), F.nullif(key, F.lit(""))))
    fit = rows.groupBy("node").agg(F.every(F.col("direct") & F.col("key").isNotNull()).alias("whole"), F.min("key").alias("a"), F.max("key").alias("b")).filter("whole AND a <> b").select("node")
    named = rows.groupBy("node", "key").agg(F.min_by("artist", F.struct(F.length("artist"), nocase_key("artist"), "artist")).alias("drawer"), F.min("artist_id").alias("drawer_artist_id"))
    return rows.join(fit, "node", "left_semi").join(named, ["node", "key"]).select("node", "root_id", "rel_path", "drawer", "drawer_artist_id")

