"""Songs of audio files by their sheets: which sheet speaks for a file, where each song begins and ends, and what it is called."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import stem
from shelfmark.functions.folders import file_title


def spoken_for(sheets: DataFrame, audio: DataFrame) -> DataFrame:
    """(file_id, sheet_id, reference, score): of all ``sheets`` (sheet_id, folder, rel_path, reference) that name a file of their folder, the best for each.

    An equal name scores 3, an equal stem 2, letters of either case; the earliest path wins a tie. ``audio`` has file_id, folder, name.
    """
    said = sheets.select("sheet_id", "folder", F.col("rel_path").alias("sheet_path"), "reference", F.lower("reference").alias("_name"), F.lower(stem("reference")).alias("_stem"))
    files = audio.select("file_id", "folder", F.lower("name").alias("_file"), F.lower(stem("name")).alias("_stem"))
    met = said.join(files, ["folder", "_stem"]).withColumn("score", F.when(F.col("_name") == F.col("_file"), 3).otherwise(2))
    return met.groupBy("file_id").agg(F.min_by(F.struct("sheet_id", "reference", "score"), F.struct(-F.col("score"), "sheet_path", "reference", "sheet_id")).alias("s")).select("file_id", "s.*")


def songs(tracks: DataFrame, sheets: DataFrame, audio: DataFrame) -> DataFrame:
    """(file_id, sheet_id, ordinal, title, title_source, start_ms, end_ms): songs of every file of ``audio`` (file_id, folder, name, album, tag_title, duration_ms).

    A file that a sheet speaks for has the sheet's ``tracks`` (sheet_id, place, file, title, start_ms); each ends where the next begins,
    the last with the file. Any other file is one song. A title is the sheet's, else the tag's where the file is one song, else what the file's name says.
    """
    chosen = spoken_for(sheets, audio)
    cut = chosen.join(tracks.withColumnRenamed("file", "reference"), ["sheet_id", "reference"]).select("file_id", "sheet_id", "place", "title", "start_ms")
    whole = audio.join(cut.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(None).alias("sheet_id"), F.lit(1).alias("place"), F.lit(None).alias("title"), F.lit(None).alias("start_ms"))
    rows = cut.unionByName(whole).join(audio.select("file_id", "name", "album", "tag_title", "duration_ms"), "file_id")
    of = Window.partitionBy("file_id")  # the songs of one file
    own = F.nullif(F.btrim("title"), F.lit(""))
    tag = F.when(F.count("*").over(of) == 1, F.nullif(F.btrim("tag_title"), F.lit("")))
    named = rows.withColumn("_cue", own).withColumn("_tag", tag).withColumn("ordinal", F.row_number().over(of.orderBy("place"))).withColumn("_next", F.lead("start_ms").over(of.orderBy("place")))
    source = F.when(F.col("_cue").isNotNull(), "cue").when(F.col("_tag").isNotNull(), "tag").otherwise("name")
    return named.select("file_id", "sheet_id", "ordinal", F.coalesce("_cue", "_tag", file_title("name", "album")).alias("title"), source.alias("title_source"), "start_ms", F.when(F.col("start_ms").isNotNull(), F.coalesce("_next", "duration_ms")).alias("end_ms"))


def unmatched(sheets: DataFrame, audio: DataFrame) -> DataFrame:
    """Sheets that speak for no file: none of what they name is there, or others say it better."""
    return sheets.join(spoken_for(sheets, audio).select("sheet_id"), "sheet_id", "left_anti").select("sheet_id", "folder", "rel_path", "reference")
