"""Which sheet speaks for a file, where songs end, and where their titles come from."""

from shelfmark.operators import issues, segments


def tables(spark):
    sheets = spark.createDataFrame([(1, "f", "f/b.cue", "Image.WAV"), (2, "f", "f/a.cue", "image.flac"), (3, "f", "f/c.cue", "gone.wav"), (4, "g", "g/x.cue", "one.ape"), (5, "f", "f/a2.cue", "image.ape")], "sheet_id int, folder string, rel_path string, reference string")
    audio = spark.createDataFrame([(10, "f", "image.wav", "Al", "tag", 9000), (11, "g", "One.APE", "Al", " Tagged ", 5000), (12, "g", "02 - Al - Name.mp3", "Al", " ", None), (13, "g", "03.mp3", None, "Third", 1)], "file_id int, folder string, name string, album string, tag_title string, duration_ms int")
    tracks = spark.createDataFrame([(1, 1, "Image.WAV", "A", 0), (1, 2, "Image.WAV", " ", 3000), (1, 3, "Image.WAV", None, 4000), (1, 4, "other.wav", "X", 0), (2, 1, "image.flac", "no", 0), (4, 1, "one.ape", None, 0)], "sheet_id int, place int, file string, title string, start_ms int")
    return tracks, sheets, audio


def test_sheets_and_files(spark):
    _, sheets, audio = tables(spark)
    assert {tuple(r) for r in segments.spoken_for(sheets, audio).collect()} == {(10, 1, "Image.WAV", 3), (11, 4, "one.ape", 3)}
    assert {r["sheet_id"] for r in segments.unmatched(sheets, audio).collect()} == {2, 3, 5}
    only = sheets.filter("sheet_id IN (2, 5)")
    assert [tuple(r) for r in segments.spoken_for(only, audio).collect()] == [(10, 2, "image.flac", 2)]


def test_songs(spark):
    got = {(r["file_id"], r["ordinal"]): tuple(r)[3:] for r in segments.songs(*tables(spark)).collect()}
    assert got == {
        (10, 1): ("A", "cue", 0, 3000), (10, 2): ("image", "name", 3000, 4000), (10, 3): ("image", "name", 4000, 9000), (11, 1): ("Tagged", "tag", 0, 5000), (12, 1): ("Name", "name", None, None), (13, 1): ("Third", "tag", None, None),
    }


def test_issues_of_sheets(spark):
    _, sheets, audio = tables(spark)
    tracks = spark.createDataFrame([(1, 1, 1, 1, 0), (1, 2, 1, 2, 5), (1, 3, None, 3, None)], "sheet_id int, place int, track int, ordinal int, start_ms int")
    got = {(r["kind"], r["severity"], r["rel_path"], r["detail"]) for r in issues.of_sheets(segments.unmatched(sheets, audio), tracks, "sheet_id").collect()}
    assert got == {
        ("cue-file-missing", "warn", "f/a.cue", "image.flac"), ("cue-file-missing", "warn", "f/c.cue", "gone.wav"), ("cue-file-missing", "warn", "f/a2.cue", "image.ape"),
        ("cue-number-mended", "info", None, "1: 1"), ("cue-number-mended", "info", None, "1: none"), ("cue-start-missing", "error", None, "1: 3"),
    }
