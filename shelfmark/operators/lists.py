"""Playlist files taken into the library, and records that share a name told apart by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import basename, folder_of, nocase_key
from shelfmark.functions.folders import folder_names, record_version


def imported(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts on lists (root_id, list_id, entries, folders, verdict, missing), and the entries (list_id, position, file_id) of curated ones.

    ``entries`` has root_id, list_id, position and path, null for streams; ``files`` has file_id, root_id and rel_path.
    A list whose files lie in one folder says what the folder says: it is redundant. Paths meet in letters of either case.
    Entries keep their order, and files that are missing leave no gap. Files are never sent whole to every task: they
    meet entries where they were grouped, and entries without a path ask for none.
    """
    known = files.groupBy("root_id", nocase_key("rel_path").alias("_key")).agg(F.min("file_id").alias("file_id")).hint("merge")
    asked = entries.withColumn("_key", nocase_key("path"))
    there = asked.filter("path IS NOT NULL").join(known, ["root_id", "_key"], "left")
    met = there.unionByName(asked.filter("path IS NULL").withColumn("file_id", F.lit(None).cast(files.schema["file_id"].dataType)))
    on_disk = F.col("path").isNotNull()
    lists = met.groupBy("root_id", "list_id").agg(F.count("*").alias("entries"), F.countDistinct(F.when(on_disk, nocase_key(folder_of("path")))).alias("folders"), F.count_if(on_disk & F.col("file_id").isNull()).alias("missing"))
    told = lists.withColumn("verdict", F.when(F.col("folders") > 1, "curated").otherwise("redundant"))
    curated = told.filter("verdict = 'curated'").select("root_id", "list_id")
    place = F.row_number().over(Window.partitionBy("root_id", "list_id").orderBy("position")) - 1  # one playlist file's lines
    kept = met.filter("file_id IS NOT NULL").join(curated, ["root_id", "list_id"], "left_semi").select("root_id", "list_id", place.alias("position"), "file_id")
    return told, kept


def numbered(records: DataFrame) -> DataFrame:
    """(kind, id, title) of ``records`` (kind, id, artist_id, title, rel_path) that share artist, title and what their folder's note says beyond the title, numbered by path.

    A number that a title has already is left out first. Numbers are counted in ranges of the path, so that a name that
    very many records share is numbered in many tasks.
    """
    said = folder_names(records.filter("artist_id IS NOT NULL AND title IS NOT NULL").withColumn("_name", basename("rel_path")), "_name")
    base = said.withColumn("base", F.btrim(F.regexp_replace("title", r" \([0-9]+\)$", ""))).filter("base <> ''").withColumn("_v", record_version(F.col("said")))
    same = ["artist_id", "base", "note"]
    keyed = base.withColumn("note", F.when(F.col("_v").isNotNull() & ~F.contains("base", F.col("_v")), F.col("_v")).otherwise("")).select("kind", "id", *same, "rel_path", F.left("rel_path", F.lit(3)).alias("_range"))
    counts = keyed.groupBy(*same, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*same)
    ranges = counts.withColumn("_all", F.sum("_n").over(whole)).withColumn("_before", F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).filter("_all > 1").drop("_n")
    place = F.row_number().over(Window.partitionBy(*same, "_range").orderBy("rel_path", "id", "kind"))
    return keyed.join(ranges, [*same, "_range"]).select("kind", "id", F.concat("base", F.lit(" ("), (F.col("_before") + place).cast("string"), F.lit(")")).alias("title"))
