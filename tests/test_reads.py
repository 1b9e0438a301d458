"""Tags, genres, playlists and numbered names on small tables."""

from shelfmark.functions.names import names_in_tag
from shelfmark.operators import lists, tags


def test_places_and_older_blocks(spark):
    rows = [(1, 0, "artist", "A", False), (1, 1, "artist", "B", False), (1, 2, "artist", "old", True), (1, 3, "date", "1999", True), (1, 4, "date", "2000", True), (2, 0, "artist", "old", True), (3, 0, None, "x", False)]
    got = tags.placed(spark.createDataFrame(rows, "file_id int, seq int, name string, value string, older boolean"))
    assert {tuple(r) for r in got.collect()} == {(1, "artist", "A", 0), (1, "artist", "B", 1), (1, "date", "1999", 0), (1, "date", "2000", 1), (2, "artist", "old", 0), (3, None, "x", 0)}


def test_genres(spark):
    want = {"(1)": "Rock", "1": "Rock", "(0)Euro": "Pop", "RX": "Remix", "(CR)": "Cover", "(9)": "(9)", "Rock": "Rock", "(": "(", "(1": "(1", "": "", "()x": "()x", "99999999999": "99999999999", None: None}
    df = spark.createDataFrame([(k,) for k in want], "g string")
    assert {r["g"]: r["x"] for r in df.select("g", tags.resolved_genre("g", ["Pop", "Rock"]).alias("x")).collect()} == want


def test_names_in_a_tag(spark):
    want = {"A & B, C": ["A", "B", "C"], "A": ["A"], " , ": [], "": [], "A feat. B,C,": ["A", "B", "C"]}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: list(r["x"]) for r in df.select("t", names_in_tag("t").alias("x")).collect()} == want


def test_playlists(spark):
    entries = [(1, 1, 0, "A/x.mp3"), (1, 1, 1, "a/Y.mp3"), (1, 2, 0, "A/x.mp3"), (1, 2, 1, None), (1, 2, 2, "b/gone.mp3"), (1, 2, 3, "A/x.mp3"), (1, 2, 4, "b/z.mp3"), (2, 3, 0, "A/x.mp3"), (2, 3, 1, "q/x.mp3"), (2, 4, 0, None)]
    files = [(10, 1, "a/X.mp3"), (11, 1, "A/y.mp3"), (12, 1, "b/z.mp3")]
    told, kept = lists.imported(spark.createDataFrame(entries, "root_id int, list_id int, position int, path string"), spark.createDataFrame(files, "file_id int, root_id int, rel_path string"))
    assert {(r["list_id"], r["verdict"], r["entries"], r["folders"], r["missing"]) for r in told.collect()} == {(1, "redundant", 2, 1, 0), (2, "curated", 5, 2, 1), (3, "curated", 2, 2, 2), (4, "redundant", 1, 0, 0)}
    assert [(r["list_id"], r["position"], r["file_id"]) for r in kept.orderBy("list_id", "position").collect()] == [(2, 0, 10), (2, 1, 10), (2, 2, 12)]


def test_numbered_names(spark):
    rows = [
        ("album", 1, 1, "Songs", "b/Songs"), ("release", 1, 1, "Songs (3)", "a/Songs"), ("album", 2, 1, "Songs", "a/Songs (Cass)"), ("album", 3, 1, "Songs (Cass)", "c/Songs (Cass)"), ("album", 4, 2, "Songs", "x"), ("album", 5, None, "Songs", "y"),
        ("album", 6, 1, None, "z"), ("album", 7, 1, "(2)", "w"), ("album", 8, 1, "Songs", "b/Songs"), ("album", 9, 1, "Songs (Cass)", "d/e"),
    ]
    got = lists.numbered(spark.createDataFrame(rows, "kind string, id int, artist_id int, title string, rel_path string"))
    assert {tuple(r) for r in got.collect()} == {("release", 1, "Songs (1)"), ("album", 1, "Songs (2)"), ("album", 8, "Songs (3)"), ("album", 3, "Songs (Cass) (1)"), ("album", 9, "Songs (Cass) (2)")}


def test_ledger_of_issues(spark):
    import pytest

    from shelfmark.operators import issues

    artists = spark.createDataFrame([("a", "a", False, True), ("b", "b", True, True), ("b#2", "b", True, True), ("c", "c", False, False)], "key string, base string, homonym boolean, ambiguous boolean")
    twins = spark.createDataFrame([("я", "ya")], "key string, latin string")
    found = issues.of_artists(artists, twins)
    assert {(r["kind"], r["detail"]) for r in found.collect()} == {("artist-homonym", "b"), ("artist-ambiguous", "a"), ("artist-transliteration", "ya / я")}
    old = issues.issue(artists, "artists", "old", "info", artists["key"]).unionByName(issues.issue(twins, "tags", "kept", "error", twins["key"]))
    after = issues.taken_in(old, found, ["artists"])
    assert {r["kind"] for r in after.collect()} == {"artist-homonym", "artist-ambiguous", "artist-transliteration", "kept"}
    assert {r["stage"] for r in issues.taken_in(after, found.limit(0), ["artists"]).collect()} == {"tags"}
    with pytest.raises(ValueError):
        issues.issue(artists, "x", "y", "fatal", artists["key"])
