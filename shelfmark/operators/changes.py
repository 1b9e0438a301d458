"""What changed under the roots between two scans, with files that were still being written held back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.expressions import ancestors

KEY = ["root_id", "rel_path"]
#: Milliseconds that a file has to lie untouched before it counts as written.
SETTLE_MS = 5_000


def young(seen: DataFrame, now_ms: int, window_ms: int = SETTLE_MS) -> DataFrame:
    """Files of ``seen`` (…, mtime_ms) that changed within the window before ``now_ms``, or after it by another clock; none for a window of 0."""
    return seen.filter((F.lit(window_ms) > 0) & (F.lit(now_ms) - F.col("mtime_ms") <= window_ms))


def moving(seen: DataFrame, again: DataFrame, now_ms: int, window_ms: int = SETTLE_MS) -> DataFrame:
    """Keys of young files that a second look (root_id, rel_path, size, mtime_ms) does not find, or finds otherwise."""
    same = again.select(*KEY, "size", "mtime_ms")
    return young(seen, now_ms, window_ms).join(same, [*KEY, "size", "mtime_ms"], "left_anti").select(*KEY)


def feed(before: DataFrame, seen: DataFrame, held: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(root_id, rel_path, state, size, mtime_ms, run) of every file that either scan knows.

    ``before`` and ``seen`` have size, mtime_ms and run. ``held`` (a key) are still moving: their row of before stays as it
    was, run and all, and a new one is not entered yet. What lies at or beneath ``closed`` (a key) could not be looked at:
    it stays, and counts as seen by this run. States: added, changed, same, held, closed, vanished; rows of vanished files
    and of held ones that are new have null values.
    """
    said = lambda df, name: df.select(*KEY, F.struct("size", "mtime_ms", "run").alias(name))
    marks = held.select(*KEY, F.lit(True).alias("moving"))
    rows = said(before, "b").join(said(seen, "a"), KEY, "full").join(marks, KEY, "left")
    run = seen.agg(F.max("run").alias("_run"))
    if closed is not None:
        lost = rows.filter("a IS NULL").select(*KEY, F.explode(ancestors("rel_path")).alias("folder"))
        under = lost.join(closed.select("root_id", F.col("rel_path").alias("folder")), ["root_id", "folder"], "left_semi").select(*KEY).distinct().withColumn("shut", F.lit(True))
        rows = rows.join(under, KEY, "left")
    else:
        rows = rows.withColumn("shut", F.lit(None).cast("boolean"))
    a, b = F.col("a"), F.col("b")
    moved = F.coalesce("moving", F.lit(False))
    alike = a["size"].eqNullSafe(b["size"]) & a["mtime_ms"].eqNullSafe(b["mtime_ms"])
    state = F.when(moved, "held").when(a.isNull() & F.col("shut"), "closed").when(a.isNull(), "vanished").when(b.isNull(), "added").when(alike, "same").otherwise("changed")
    stays = F.when(state == "closed", F.struct(b["size"].alias("size"), b["mtime_ms"].alias("mtime_ms"), F.col("_run").alias("run"))).when(moved, b).otherwise(a)
    return rows.join(F.broadcast(run)).withColumn("state", state).withColumn("row", stays).select(*KEY, "state", "row.*")


def after(feed_: DataFrame) -> DataFrame:
    """The inventory once the feed is taken in."""
    return feed_.filter("run IS NOT NULL").select(*KEY, "size", "mtime_ms", "run")
