"""The whole catalogue as lines of text, in an order that makes the same report every time.

Sections are roots, counters, what nothing accounts for, hidden records, artists with their records and songs, and issues.
Each line carries the keys that it is sorted by. What stands before the artists, the artists, and the issues are a range sort
each, and follow one another, so the files of a report of any size, read one after another, are the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import clock

ROOTS, COUNTERS, UNACCOUNTED, HIDDEN, ARTISTS, ISSUES = range(1, 7)
#: Sort keys of a line; nulls come first, but records of no artist last.
ORDER = {"section": "int", "unnamed": "boolean", "artist_key": "string", "root_id": "bigint", "rel_path": "string", "level": "int", "ordinal": "bigint"}
#: Sort keys of artists and records.
AT = ("unnamed", "artist_key", "root_id", "rel_path")
#: What rows of a place are: lines by their level, then credits of songs, and songs without a file, which only count.
HEAD, RECORD, CREDIT, SONG, OWN, LOST = range(6)


def padded(text, width: int) -> Column:
    """Text filled up to a width; longer text stays whole."""
    c = F.col(text) if isinstance(text, str) else text
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" "))


def _lines(rows: DataFrame, section: int, line: Column, **keys) -> DataFrame:
    at = {"section": F.lit(section)} | keys
    return rows.select(*(at.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in ORDER.items()), line.alias("line"))


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _where(path: str) -> Column:
    return F.when(F.col(path) == "", "(the root itself)").otherwise(F.col(path))


def marked(root: DataFrame) -> DataFrame:
    """A short mark for each root; roots are configuration, a handful."""
    return root.select(F.col("id").alias("root_id"), "path", F.concat(F.lit("#"), _text(F.row_number().over(Window.orderBy("id")))).alias("mark"))


def roots(root: DataFrame, folder: DataFrame, file: DataFrame, album: DataFrame) -> DataFrame:
    """Each root with its numbers of folders, files and albums."""
    rows = marked(root)
    for name, of in (("folders", folder), ("files", file), ("albums", album)):
        rows = rows.join(of.groupBy("root_id").agg(F.count("*").alias(name)), "root_id", "left")
    said = [x for name in ("folders", "files", "albums") for x in (F.lit(f"  {name} "), _text(F.coalesce(name, F.lit(0))))]
    return _lines(rows, ROOTS, F.concat(padded("mark", 4), "path", *said), root_id=F.col("root_id"))


def counter(rows: DataFrame, place: int, label: str, key: Column | None = None, **of: Column) -> DataFrame:
    """One line: how many rows, then how many of each key or for which each condition holds; keys are a few fixed words."""
    if key is not None:
        counted = rows.groupBy(F.coalesce(key, F.lit("none")).alias("key")).agg(F.count("*").alias("n"))
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("key", "n"))).alias("parts"))
    else:
        total = rows.agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(k).alias("key"), F.count_if(c).alias("n")) for k, c in of.items())).cast("array<struct<key: string, n: bigint>>").alias("parts"))
    parts = F.transform("parts", lambda p: F.concat(F.lit("  "), p["key"], F.lit(" "), p["n"].cast("string")))
    return _lines(total, COUNTERS, F.concat(padded(F.lit(label), 10), _text("n"), F.array_join(parts, "")), ordinal=F.lit(place))


def unaccounted(folder: DataFrame, file: DataFrame, album: DataFrame, track: DataFrame, cue: DataFrame) -> DataFrame:
    """What must be nothing: folders of no role, albums of no song, audio files of neither song nor sheet."""
    silent = album.join(track.select(F.col("album_id").alias("id")), "id", "left_anti")
    held = track.select(F.col("file_id").alias("id")).union(cue.select(F.col("audio_file_id").alias("id")))
    loose = file.filter("kind = 'audio'").join(held, "id", "left_anti")
    asked = (("folders with no role", folder.filter("role IS NULL")), ("albums with no track", silent), ("audio files with no track or cue", loose))
    return reduce(DataFrame.union, (_lines(rows.agg(F.count("*").alias("n")), UNACCOUNTED, F.concat(padded(F.lit(label), 34), _text("n")), ordinal=F.lit(i)) for i, (label, rows) in enumerate(asked)))


def hidden(root: DataFrame, album: DataFrame) -> DataFrame:
    """Hidden records by name, with who hid them and why."""
    rows = album.filter("junk_reason IS NOT NULL").join(F.broadcast(marked(root)), "root_id", "left")
    who = F.when(F.col("junk_source") == "hand", "hand").otherwise("scan")
    line = F.concat(padded(who, 6), padded(F.coalesce("mark", F.lit("?")), 4), padded(_where("rel_path"), 44), F.coalesce("title", F.lit("")), F.lit("  -  "), "junk_reason")
    return _lines(rows, HIDDEN, line, root_id=F.col("root_id"), rel_path=F.col("rel_path"), ordinal=F.col("id"))


def credits(credit: DataFrame, key: str) -> DataFrame:
    """The text of each ordered credit, put together again from its phrases and names, and how many names it has."""
    parts = F.array_sort(F.collect_list(F.struct("position", "phrase", "name")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["phrase"], p["name"])), "")
    return credit.groupBy(key).agg(parts.alias("parts")).select(key, text.alias("credit"), F.size("parts").alias("names"))


def performers(cue: DataFrame, cue_track: DataFrame) -> DataFrame:
    """Who performs each song of an audio file: what the first of its sheets says."""
    said = cue.select(F.col("id").alias("cue_id"), "audio_file_id").join(cue_track, "cue_id")
    first = said.groupBy("audio_file_id", "ordinal").agg(F.min_by(F.struct("performer"), "cue_id").alias("first"))
    return first.select(F.col("audio_file_id").alias("file_id"), "ordinal", F.col("first.performer").alias("performer"))


def places(album: DataFrame, artist: DataFrame) -> DataFrame:
    """Artists (level 0) and their records (level 1), each with its ``place`` in the report, to be written before it is used.

    A place is a number that sorts as the keys do, the same for rows of the same keys, which ``nth`` tells apart; songs move with it
    instead of the keys.
    """
    who = artist.select(F.col("id").alias("artist_id"), F.col("name").alias("artist_name"), F.col("name_key").alias("artist_key"))
    rows = album.join(who, "artist_id", "left").withColumn("unnamed", F.col("artist_key").isNull())
    owners = rows.groupBy("unnamed", "artist_key", "artist_id").agg(F.first("artist_name").alias("name"), F.count("*").alias("n"))
    split = F.when(F.contains("artist_key", F.lit("#")), F.concat(F.lit("  ["), "artist_key", F.lit("]"))).otherwise(F.lit(""))
    head = F.concat(padded(F.coalesce("name", F.lit("(unattributed)")), 40), F.lit("  "), _text("n"), F.when(F.col("n") == 1, " album").otherwise(" albums"), split)
    heads = owners.select("unnamed", "artist_key", F.lit(0).alias("level"), F.col("artist_id").cast("bigint").alias("ordinal"), head.alias("title"))
    records = rows.select(*AT, F.lit(1).alias("level"), F.col("id").cast("bigint").alias("ordinal"), "title", "release_id", "disc_number", "credit_raw")
    ranked = heads.unionByName(records, allowMissingColumns=True).repartitionByRange(*AT).sortWithinPartitions(*AT, "level", "ordinal")
    numbered = ranked.withColumn("row", F.monotonically_increasing_id()).withColumn("place", F.min("row").over(Window.partitionBy(*AT)))
    return numbered.withColumn("nth", (F.col("row") - F.col("place")).cast("int")).drop("row")


def in_places(track: DataFrame, place: DataFrame) -> DataFrame:
    """Songs with the place of their record, null where there is none; ``again`` where a record has several and this is not the first."""
    first = Window.partitionBy("album_id").orderBy("place", "nth")
    at = place.filter("level = 1").select(F.col("ordinal").alias("album_id"), "place", "nth").withColumn("again", F.row_number().over(first) > 1)
    return track.join(at, "album_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))


def artists(root: DataFrame, file: DataFrame, place: DataFrame, release: DataFrame, track: DataFrame, album_credit: DataFrame, track_credit: DataFrame, performer: DataFrame) -> DataFrame:
    """Artists by key, then records by root and path, each with its credit, where that has several names, and its songs; in order.

    Songs meet their files by one shuffle, as text, and then go to their place; what records and credits say of them meets them there.
    """
    at = F.struct(*AT, "title", "credit_raw", "mark").alias("album")
    disc, box = F.concat(F.lit("  disc "), _text("disc_number")), F.concat(F.lit(" of "), F.col("box"))
    rows, boxes = place.join(F.broadcast(marked(root).select("root_id", "mark")), "root_id", "left"), release.select(F.col("id").alias("release_id"), F.col("title").alias("box"))
    boxed = rows.filter("release_id IS NOT NULL").join(boxes, "release_id", "left")
    text = F.when(F.col("level") == HEAD, F.col("title")).otherwise(F.concat(F.coalesce(disc, F.lit("")), F.coalesce(box, F.lit(""))))
    records = boxed.unionByName(rows.filter("release_id IS NULL"), allowMissingColumns=True).select("place", "nth", F.col("level").alias("kind"), "ordinal", at, text.alias("text"))

    of = place.filter("level = 1").select(F.col("ordinal").alias("album_id"), "place", "nth")
    shared = of.join(credits(album_credit, "album_id").filter("names > 1"), "album_id")
    credited = shared.select("place", "nth", F.lit(CREDIT).alias("kind"), F.col("album_id").alias("ordinal"), F.concat(F.lit("    credit  "), "credit").alias("text"))

    track = track.filter("place IS NOT NULL")
    number = _text("ordinal")
    song = F.concat(F.lit("    "), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")), F.lit(". "), padded(clock("duration_ms"), 7), F.coalesce("title", F.lit("(untitled)")), F.lit("  "))
    segment = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit("  ["), clock("start_ms"), F.lit("-"), clock("end_ms"), F.lit("]"))).otherwise("")
    sung = track.select("place", "nth", "id", "file_id", "ordinal", song.alias("song"), segment.alias("segment"))
    said = performer.filter("ordinal IS NOT NULL AND btrim(performer) <> ''").groupBy(F.col("file_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ordinal").cast("bigint"), "performer"))).alias("said"))
    copy = F.row_number().over(Window.partitionBy("id").orderBy("rel_path"))  # a song counts once, however many rows its file has
    files = file.withColumn("copy", copy).select("id", F.col("rel_path").alias("path"), "copy").join(said, "id", "left").withColumnRenamed("id", "file_id")
    found = sung.filter("file_id IS NOT NULL").join(files, "file_id", "left").unionByName(sung.filter("file_id IS NULL"), allowMissingColumns=True)
    kind, counts = F.when(F.col("copy").isNotNull(), SONG).otherwise(LOST), F.coalesce("copy", F.lit(1)) == 1
    songs = found.select("place", "nth", kind.alias("kind"), F.col("id").alias("ordinal"), F.concat("song", "path", "segment").alias("text"), F.element_at("said", F.col("ordinal").cast("bigint")).alias("by"), counts.alias("counts"), (F.col("segment") != "").alias("cut"))

    own = credits(track_credit, "track_id").select(F.col("track_id").alias("ordinal"), F.col("credit").alias("by"))
    owned = track.select("place", "nth", F.col("id").alias("ordinal")).join(own, "ordinal").withColumn("kind", F.lit(OWN))

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (records, credited, songs, owned)).repartitionByRange("place")
    record, one = Window.partitionBy("place", "nth"), Window.partitionBy("place", "nth", "ordinal")
    met = every.withColumn("credit", F.max(F.when(F.col("kind") == OWN, F.col("by"))).over(one)).withColumns({"of": F.first("album", ignorenulls=True).over(record), "n": F.count_if("counts").over(record), "split": F.bool_or("cut").over(record)})
    facts = F.concat(_text("n"), F.when(F.col("n") == 1, " track").otherwise(" tracks"), F.when(F.col("split"), "  split").otherwise(""), "text")
    told = F.concat(F.lit("  "), padded(F.coalesce("album.mark", F.lit("?")), 4), padded(facts, 30), F.lit("  "), _where("album.rel_path"), F.lit("  -  "), F.coalesce("album.title", F.lit("")))
    stranger = F.when(~F.col("by").eqNullSafe(F.col("of.credit_raw")), F.col("by"))
    by = F.coalesce(F.concat(F.lit("  by "), F.coalesce("credit", stranger)), F.lit(""))
    line = F.when(F.col("kind") == RECORD, told).when(F.col("kind") == SONG, F.concat("text", by)).otherwise(F.col("text"))
    lines = met.filter(F.col("kind") <= SONG).select("place", "kind", "ordinal", line.alias("line"), *(F.col(f"of.{k}") for k in AT)).sortWithinPartitions("place", "kind", "ordinal", "line")
    return _lines(lines, ARTISTS, F.col("line"), **{k: F.col(k) for k in AT}, level=F.col("kind"), ordinal=F.col("ordinal"))


def issues(root: DataFrame, issue: DataFrame) -> DataFrame:
    """The ledger, the gravest first."""
    rows = issue.join(F.broadcast(marked(root)), "root_id", "left")
    line = F.concat(padded("severity", 6), padded("kind", 24), padded(F.coalesce("mark", F.lit("")), 4), padded(F.coalesce("rel_path", F.lit("")), 40), F.coalesce("detail", F.lit("")))
    grave = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return _lines(rows, ISSUES, line, artist_key=F.col("kind"), root_id=F.col("root_id"), rel_path=F.col("rel_path"), level=grave)


def in_order(*sections: DataFrame) -> DataFrame:
    """All lines of some sections in the report's order; equal keys by the text itself."""
    keys = [k for k in ORDER if k != "level"]
    first = F.when(F.col("section") == ISSUES, F.col("level"))  # issues go by gravity before anything else
    return reduce(DataFrame.union, sections).orderBy("section", first, *keys[1:5], "level", "ordinal", "line")


def write(report: DataFrame, path: str) -> None:
    """The lines as text files that follow one another by name."""
    report.select("line").write.text(path)
