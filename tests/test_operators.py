from pyspark.sql import functions as F

from shelfmark.functions import expressions as X
from shelfmark.operators import keyed, paths, search
from shelfmark.streaming import plays


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 2000, "x"), (2, "b", 2001, None)], "id int, title string, year int, star string")
    new = spark.createDataFrame([(2, "B", None, "y"), (3, "c", None, None), (1, None, 1999, "z")], "id int, title string, year int, star string")
    out = keyed.upsert(old, new, ["id"], keep_old=("star",), keep_known=("year",)).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, None, 1999, "x"), (2, "B", 2001, "y"), (3, "c", None, None)]


def test_snapshots(spark):
    rows = lambda *x: spark.createDataFrame(x, "path string, size int")
    out = keyed.compare(rows(("a", 1), ("b", None), ("c", 3)), rows(("a", 1), ("b", 2), ("d", 4)), ["path"], ["size"])
    assert dict(out.collect()) == {"a": "same", "b": "changed", "c": "vanished", "d": "added"}
    held = spark.createDataFrame([("c",)], "path string")
    assert keyed.swept(rows(("a", 1), ("c", 3), ("e", 5)), rows(("a", 1)), ["path"], held).count() == 2


def test_lists(spark):
    entries = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "list int, position int, item string")
    more = spark.createDataFrame([(1, 0, "z")], "list int, position int, item string")
    out = keyed.removed_and_appended(entries, "list", [1], more).orderBy("list", "position").collect()
    assert [(r["list"], r["position"], r["item"]) for r in out] == [(1, 0, "a"), (1, 1, "c"), (1, 2, "z"), (2, 0, "d")]


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a/bc",), ("d",)], "rel_path string")
    folders = spark.createDataFrame([("a",), ("a/b",), ("x",)], "folder string")
    assert dict(paths.counts_under(rows, folders).collect()) == {"a": 2, "a/b": 1, "x": 0}
    assert dict(paths.owner(rows, folders).collect()) == {"a/b/c": "a/b", "a/bc": "a"}


def test_search(spark):
    rows = spark.createDataFrame([(1, "Blue Train"), (2, "blue trains, blue"), (3, "Train"), (4, None)], "id int, text string")
    assert {r["id"] for r in search.matching(rows, "text", ["blue", "tra"]).collect()} == {1, 2}
    assert {r["id"] for r in search.matching(rows, "text", ["train", "blue"]).collect()} == {1}
    assert [tuple(r) for r in search.ask(search.postings(rows, "id", "text"), "id", ["blue", "train"], prefix=False).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in search.ask(search.postings(rows, "id", "text"), "id", ["blue", "train"]).collect()) == [(1, 2), (2, 3)]


def test_expressions(spark):
    row = spark.range(1).select(
        X.clock(F.lit(3_661_000)).alias("clock"), X.cue_time(F.lit("01:02:37")).alias("cue"), X.file_kind(F.lit("A.FLAC")).alias("kind"), X.disc_number(F.lit("Name (Disc 2)")).alias("disc"),
        X.index_letter(F.lit("éa")).alias("letter"), X.sort_key(F.lit("The Who")).alias("sort"), X.half_up(F.lit(-0.5)).alias("half"), X.extension(F.lit(".hidden")).alias("ext"), X.year_of(F.lit("0999-01")).alias("year"),
    ).first()
    assert tuple(row) == ("1:01:01", 62493, "audio", 2, "É", "Who, The", 0, "", None)


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = plays.rollup(plays.read(spark, f"{tmp_path}/in", events.schema, 1))
    stream.writeStream.format("memory").queryName("plays").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    ours = {tuple(r) for r in spark.table("plays").collect()}
    assert ours == {tuple(r) for r in plays.rollup(events).collect()}


def test_orphans(spark):
    from shelfmark.plans.collections import unused

    artists = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "artist_id int")
    assert [r["id"] for r in unused(artists, names(1, None), names(1, 3)).collect()] == [2]


def test_new_members_are_numbered_on(spark):
    known = spark.createDataFrame([("a", 7)], "name string, id bigint")
    new = spark.createDataFrame([(x,) for x in ["a", "b", "c", "b", None]], "name string")
    out = dict(keyed.with_new_members(known, new, "name", "id").collect())
    assert out["a"] == 7 and sorted(out.values()) == [7, 8, 9] and set(out) == {"a", "b", "c"}


def test_odd_sheets(spark):
    from shelfmark.sources import sheets

    rows = spark.createDataFrame([(1, None, "f"), (2, "", "f"), (3, "TRACK x AUDIO\nINDEX 01 00:00:00", "f"), (4, 'FILE x.wav WAVE\nTRACK 01 AUDIO\nTITLE "A"\nTITLE "B"\nINDEX 01 99:99:99', "f")], "id int, text string, folder string")
    assert [(r["id"], r["track"], r["title"], r["file"], r["start_ms"]) for r in sheets.cue_tracks(rows, "id").collect()] == [(4, 1, "A", "x.wav", None)]
    lists = spark.createDataFrame([(1, "﻿#EXTM3U\r\n'a b.mp3'\r\n\r\n..\\c.mp3", "f/g"), (2, None, "f")], "id int, text string, folder string")
    assert [(r["position"], r["path"]) for r in sheets.playlist_entries(lists, "id", "folder").orderBy("position").collect()] == [(0, "f/g/a b.mp3"), (1, "f/c.mp3")]


def test_repeated_track_numbers(spark):
    from shelfmark.sources import sheets

    text = 'FILE "a.wav" WAVE\nTRACK 01 AUDIO\nTITLE A1\nINDEX 01 00:00:00\nTRACK 02 AUDIO\nTITLE A2\nINDEX 01 01:00:00\nFILE "b.wav" WAVE\nTRACK 01 AUDIO\nTITLE B1\nINDEX 01 00:00:00\nTRACK 07 AUDIO\nTITLE B7\nINDEX 01 02:00:00'
    rows = sheets.cue_tracks(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("place").collect()
    assert [(r["place"], r["track"], r["ordinal"], r["title"], r["file"]) for r in rows] == [(1, 1, 1, "A1", "a.wav"), (2, 2, 2, "A2", "a.wav"), (3, 1, 3, "B1", "b.wav"), (4, 7, 7, "B7", "b.wav")]


def test_files_by_reference(spark):
    from shelfmark.plans.upkeep import file_matches

    have = spark.createDataFrame([(1, "r", "A.wav", "x/A.wav"), (2, "r", "a.flac", "a/a.flac"), (3, "r", "b.ape", "b.ape"), (4, "s", "a.wav", "a.wav")], "file_id int, root string, name string, rel_path string")
    wanted = spark.createDataFrame([(1, "r", "a.WAV"), (2, "r", "a.mp3"), (3, "r", "c.wav"), (4, "s", "A.ape"), (5, None, "a.wav"), (6, "r", None)], "id int, root string, reference string")
    assert {tuple(r) for r in file_matches(wanted, have, ["root"]).collect()} == {(1, 1, 3), (2, 2, 2), (4, 4, 2)}


def test_text_kernels(spark):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2024, 5, 1, 23, 30),)], "now timestamp")
    row = df.select(
        X.quiet("now", 22, 6).alias("a"), X.quiet("now", 6, 22).alias("b"), X.quiet("now", 3, 3).alias("c"), X.cut_path(F.lit("a/b.flac"), F.lit(3)).alias("d"), X.cut_path(F.lit("a.b/c"), F.lit(3)).alias("e"), X.cut_path(F.lit("x.mp3"), F.lit(None).cast("int")).alias("f"),
        X.play_time(F.lit("1000"), "now").alias("g"), X.play_time(F.lit("x"), "now").alias("h"), X.play_time(F.lit("9" * 30), "now").alias("i"), X.listed_texts(F.lit('["a", 1, null, "b"]')).alias("j"), X.listed_texts(F.lit("{")).alias("k"),
        X.replay_gain(F.lit("-6 dB"), F.lit("x"), F.lit("0.5"), F.lit("-1")).alias("l"), X.replay_gain(*[F.lit(None).cast("string")] * 4).alias("m"), X.first_word(F.lit("a/- Front.2.jpg")).alias("n"),
        X.minutes_ago(F.lit("2024-05-01 23:00:30").cast("timestamp"), "now").alias("o"), X.is_text(F.lit("a\u0001b\u0002")).alias("p"), X.explicit_status(F.lit(None).cast("int"), F.lit(4)).alias("q"), X.parse_id(F.lit("al-12"))[1].alias("r"), X.parse_id(F.lit("xx-1"))[0].alias("s"),
    ).first()
    now = datetime(2024, 5, 1, 23, 30)
    assert tuple(row) == (True, False, False, "a/b (track 3).flac", "a.b/c (track 3)", "x.mp3", datetime(1970, 1, 1, 0, 0, 1), now, now, ["a", "b"], [], {"trackGain": -6.0, "trackPeak": 0.5}, None, "front", 29, False, "explicit", 12, None)


def test_odd_names(spark):
    from shelfmark.functions import folders

    names = [None, "", " - ", "(CD)", "1999 - ", "a - [b - (c - d)] - e", "_-_x", "x - 　- y"]
    rows = folders.folder_names(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "name").select("id", "name", "said.*").orderBy("id").collect()
    assert [(r["credit"], r["title"], r["format"]) for r in rows] == [(None, None, None), (None, None, None), (None, "-", None), (None, None, "CD"), (None, "1999 -", None), (None, "a - [b - (c - d)] - e", None), (None, "_-_x", None), (None, "x - y", None)]
    pairs = spark.createDataFrame([(None, None), ("", "a"), ("01 - .flac", None), ("a - b.mp3", "")], "name string, album string")
    assert [r[0] for r in pairs.select(folders.file_title("name", "album")).collect()] == [None, "", "01 -", "a - b"]
