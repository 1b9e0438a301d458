"""Cue sheets and playlist files as tables: texts are cut into lines. A sheet is a small text, and read within its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import cue_time, resolved, unique_ordinals


def _cut(text: str) -> F.Column:
    """The lines of a text without a byte order mark and outer white space."""
    cut = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^\ufeff", ""), r"\r\n|\n|\r")
    return F.transform(cut, lambda x: F.btrim(x, F.lit(" \t\f\u00a0")))


def lines(sheets: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, said): numbered lines."""
    return sheets.select(key, F.posexplode(_cut(text)).alias("line", "said"))


def _unquoted(c) -> F.Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, '^"(.*)"$', "$1"), "^'(.*)'$", "$1"))


def cue_tracks(sheets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each TRACK line of each cue sheet: its place, its number and a number of its own, title, performer (the sheet's where it has none), file, pregap and start in ms.

    Numbers repeat where a sheet names several files, each with a first track. Songs are told apart by their place;
    ``ordinal`` is the number where it is the first to claim it, else the next that is free.
    """
    said = F.transform(_cut(text), lambda x: F.struct(F.upper(F.regexp_extract(x, r"^(\S+)", 1)).alias("word"), F.regexp_extract(x, r"^\S+\s+(.*)$", 1).alias("rest")))
    number = lambda x: F.when(x["word"] == "TRACK", F.regexp_extract(x["rest"], r"^(\d+)", 1).try_cast("int"))
    first = lambda rows, word: _unquoted(F.get(F.filter(rows, lambda x: x["word"] == word), F.lit(0))["rest"])
    told = sheets.select(key, F.filter(said, lambda x: x["word"].isin("TRACK", "FILE", "TITLE", "PERFORMER", "INDEX")).alias("said"))
    of = lambda what: F.filter(F.transform("said", what), lambda x: x.isNotNull())
    told = told.withColumn("starts", of(lambda x, i: F.when(number(x).isNotNull(), F.struct(i.alias("at"), number(x).alias("track")))))
    told = told.withColumn("files", of(lambda x, i: F.when(x["word"] == "FILE", F.struct(i.alias("at"), _unquoted(F.regexp_replace(x["rest"], r"\s+\S+$", "")).alias("file")))))
    head = F.slice("said", 1, F.coalesce(F.get("starts", F.lit(0))["at"], F.size("said")))
    songs = F.transform("starts", lambda s, i: F.struct(s["at"].alias("at"), s["track"].alias("track"), F.slice("said", s["at"] + 1, F.coalesce(F.get("starts", i + 1)["at"], F.size("said")) - s["at"]).alias("rows")))
    ordinals = unique_ordinals(F.transform("starts", lambda s: s["track"]))
    each = told.select(key, "files", first(head, "PERFORMER").alias("by"), first(head, "TITLE").alias("sheet_title"), ordinals.alias("ordinals"), F.posexplode(songs).alias("i", "song"))
    rows = F.col("song.rows")
    last = F.size(rows) - F.array_position(F.reverse(F.transform(rows, lambda x: x["word"])), "INDEX").cast("int")  # its last INDEX; its last row where it has none
    last = F.col("song.at") + F.when(F.exists(rows, lambda x: x["word"] == "INDEX"), last).otherwise(F.size(rows) - 1)
    file = F.try_element_at(F.filter("files", lambda f: f["at"] <= last), F.lit(-1))["file"]
    index = lambda n: F.array_min(F.transform(F.filter(rows, lambda x: (x["word"] == "INDEX") & x["rest"].rlike(rf"^0*{n}\s")), lambda x: cue_time(F.regexp_extract(x["rest"], r"\s(\S+)$", 1))))
    return each.select(
        key, (F.col("i") + 1).alias("place"), "song.track", F.get("ordinals", F.col("i")).alias("ordinal"), first(rows, "TITLE").alias("title"), F.coalesce(first(rows, "PERFORMER"), "by").alias("performer"),
        "sheet_title", file.alias("file"), index(0).alias("pregap_ms"), index(1).alias("start_ms"),
    )


def playlist_entries(lists: DataFrame, key: str, folder: str, text: str = "text") -> DataFrame:
    """(key, position, entry, path): lines that are no comments, unquoted; streams have no path, other entries that of their folder."""
    said = lines(lists, key, text).filter("said <> '' AND NOT startswith(said, '#')").select(key, "line", _unquoted(F.col("said")).alias("entry")).filter("entry <> ''")
    place = F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1
    stream = F.col("entry").rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
    path = F.when(~stream, F.when(F.col("entry").startswith("/"), resolved(F.lit(""), "entry")).otherwise(resolved(folder, "entry")))
    return said.join(lists.select(key, F.col(folder)).distinct(), key).select(key, place.cast("bigint").alias("position"), "entry", path.alias("path"))
