"""The report's order and sections, and notes beside folders."""

from pyspark.sql import functions as F

from shelfmark.functions.notes import biography, unescaped
from shelfmark.operators import inventory
from shelfmark.plans.inventory import full_report
from shelfmark.plans.views import Views
from tests.conftest import SF


def test_references_are_resolved_once(spark):
    cases = {
        "a &amp;lt; b": "a &lt; b", "&#1046;&#x1F600;": "Ж😀", "&bogus; &#xD800; &#99999999999999999999; & &": "&bogus; &#xD800; &#99999999999999999999; & &",
        "&quot;&apos;&lt;&gt;": "\"'<>", "": "", "&amp": "&amp", "&#x;&#;": "&#x;&#;",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string").withColumn("said", unescaped("text"))
    assert {r["text"]: r["said"] for r in rows.collect()} == cases


def test_first_biography_alone(spark):
    cases = {"<biography> a\nb </biography><biography>c</biography>": "a\nb", "<outline>a</outline>": None, "<biography>&#32;</biography>": None, "<biography>open": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "xml string").withColumn("said", biography("xml"))
    assert {r["xml"]: r["said"] for r in rows.collect()} == cases


def test_first_sheet_names_the_performer(spark):
    cue = spark.createDataFrame([(2, 1), (1, 1), (3, 2)], "id bigint, audio_file_id bigint")
    said = spark.createDataFrame([(2, 1, "late"), (1, 1, None), (2, 2, "only"), (3, 1, "x")], "cue_id bigint, ordinal int, performer string")
    assert sorted(map(tuple, inventory.performers(cue, said).collect()), key=str) == [(1, 1, None), (1, 2, "only"), (2, 1, "x")]


def test_credits_are_put_together_in_order(spark):
    rows = spark.createDataFrame([(1, 2, " & ", "B"), (1, 1, "", "A"), (2, 1, "", "C")], "k int, position int, phrase string, name string")
    assert {r["k"]: (r["credit"], r["names"]) for r in inventory.credits(rows, "k").collect()} == {1: ("A & B", 2), 2: ("C", 1)}


def test_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, kind string")
    lines = [inventory.counter(empty, 0, "files", F.col("kind")), inventory.counter(empty, 1, "albums", hidden=F.col("kind").isNotNull()), inventory.counter(empty, 2, "tracks")]
    assert [r["line"] for r in inventory.in_order(*lines).collect()] == ["files     0", "albums    0  hidden 0", "tracks    0"]


def test_written_report_reads_in_order(spark, tmp_path):
    report = full_report(Views(spark, SF))
    inventory.write(report, str(tmp_path / "report"))
    text = [line for part in sorted((tmp_path / "report").glob("part-*")) for line in part.read_text().splitlines()]
    rows = report.collect()
    assert text == [r["line"] for r in rows]
    assert [r["section"] for r in rows] == sorted(r["section"] for r in rows) and {r["section"] for r in rows} == set(range(1, 7))
    people = [r for r in rows if r["section"] == inventory.ARTISTS]
    assert people[0]["level"] == 0 and not people[0]["unnamed"] and people[-1]["unnamed"]
    for before, after in zip(people, people[1:], strict=False):
        assert after["level"] <= before["level"] + 1 or (before["level"], after["level"]) == (1, 3)
        assert after["level"] < 2 or after["rel_path"] == before["rel_path"]
    grave = [r["level"] for r in rows if r["section"] == inventory.ISSUES]
    assert grave == sorted(grave)


def _moved(df) -> list[set]:
    """The columns of each exchange in a plan."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().length())})
        nodes += [node.children().apply(i) for i in range(node.children().length())]
    return found


def test_songs_move_once_to_their_files_and_once_to_their_place(spark):
    """Titles, and the keys that songs are sorted by, would fill the disks if each join moved them anew."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = _moved(full_report(Views(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in moved if x & {"song", "title"} and "file_id" in x]) == 1
    assert not [x for x in moved if {"artist_key", "rel_path"} <= x and x & {"song", "line"} and "section" not in x]
    assert len([x for x in moved if "place" in x and "text" in x]) == 1


def test_records_of_one_path_stand_together(spark):
    """Equal keys: both records, then credits, then the songs of both by id; a song counts without a file, and once if its file is there twice."""
    frame = spark.createDataFrame
    root, artist = frame([(5, "/r")], "id bigint, path string"), frame([(1, "Ann", "ann")], "id int, name string, name_key string")
    album = frame([(11, 5, "a", "One", 1, None, None, "N1"), (12, 5, "a", "Two", 1, 7, 2, None)], "id bigint, root_id bigint, rel_path string, title string, artist_id int, release_id bigint, disc_number bigint, credit_raw string")
    track = frame([(21, 11, 1, 1, 1000, "x", None, None), (22, 12, 1, 2, 2000, None, 0, None), (23, 11, 2, 9, None, "gone", None, None), (24, 11, 3, None, None, "gone", None, None), (25, 99, 1, 1, 1000, "no record", None, None)],
        "id bigint, album_id bigint, ordinal int, file_id bigint, duration_ms bigint, title string, start_ms bigint, end_ms bigint")
    file, release = frame([(1, "f1"), (2, "f2"), (2, "f2b")], "id bigint, rel_path string"), frame([(7, "Box")], "id bigint, title string")
    credit = lambda key: frame([(key, 1, "", "A"), (key, 2, " & ", "B")], "k bigint, position int, phrase string, name string")
    said = frame([(1, 1, "N1"), (2, 1, "N2"), (1, None, "nobody")], "file_id bigint, ordinal int, performer string")
    place = inventory.places(album, artist).localCheckpoint()
    songs = inventory.in_places(track, place)
    report = inventory.artists(root, file, place, release, songs, credit(12).withColumnRenamed("k", "album_id"), credit(21).withColumnRenamed("k", "track_id"), said)
    assert [(r["level"], r["ordinal"], r["rel_path"], " ".join(r["line"].split())) for r in report.collect()] == [
        (0, 1, None, "Ann 2 albums"), (1, 11, "a", "#1 3 tracks a - One"), (1, 12, "a", "#1 1 track split disc 2 of Box a - Two"), (2, 12, "a", "credit A & B"),
        (3, 21, "a", "01. 0:01 x f1 by A & B"), (3, 22, "a", "01. 0:02 (untitled) f2 [0:00---:--] by N2"), (3, 22, "a", "01. 0:02 (untitled) f2b [0:00---:--] by N2"),
    ]


def test_a_tidy_stage_leaves_the_session_as_it_was(spark):
    from shelfmark.sources import kept

    for before in (None, "false"):
        if before:
            spark.conf.set(kept.CLEANUP, before)
        was = spark.conf.get(kept.CLEANUP, None)
        assert sorted(r[0] for r in kept.stage(spark.range(6).repartition(3, "id"), "tidy", tidy=True).collect()) == list(range(6))
        assert spark.conf.get(kept.CLEANUP, None) == was
    spark.conf.unset(kept.CLEANUP)
