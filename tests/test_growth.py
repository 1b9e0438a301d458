"""Plans whose largest task or whose driver must not grow with a table."""

from shelfmark.operators import lists
from shelfmark.plans import albums
from shelfmark.plans.views import Views
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_playlists_are_not_broadcast(spark):
    """Ranges are known to be small, so Spark would send the files to every task, as it does where it takes many for few."""
    entries = spark.range(3).selectExpr("cast(id % 1 as int) as root_id", "1 as list_id", "cast(id as int) as position", "case when id < 2 then substr('A/b/', 1 + 2 * cast(id as int), 2) || id end as path")
    files = spark.range(1).selectExpr("10 + id as file_id", "cast(id % 1 as int) as root_id", "'a/' || id as rel_path")
    told, kept = lists.imported(entries, files)
    for df in (told, kept):
        assert not [x for x in _plan(df).split("\n") if "BroadcastHashJoin" in x and "_key" in x]
    assert [tuple(r) for r in told.select("entries", "folders", "missing").collect()] == [(3, 2, 1)]
    assert [tuple(r) for r in kept.collect()] == [(0, 1, 0, 10)]


def test_records_without_a_release_gather_nowhere(spark):
    """A join by release_id would bring all albums that have none to one task."""
    v = Views(spark, SF)
    for df in (v.records, v.song_select, v.album_select, albums.artist_roles(v)):
        assert not [x for x in _plan(df).split("\n") if "Join" in x and "release_id" in x]


def test_references_of_artists_count_once(spark):
    """What is sent to every task, or gathered by name, is each name once and not each row."""
    from shelfmark.plans.collections import unused

    artists, rows = spark.range(4).selectExpr("cast(id as int) as id"), spark.range(1000).selectExpr("cast(if(id % 3 = 0, null, id % 3) as int) as artist_id")
    left = unused(artists, rows)
    assert "HashAggregate(keys=[artist_id" in _plan(left)
    assert sorted(r[0] for r in left.collect()) == [0, 3]


def test_a_large_bucket_of_words_is_several_files(spark, tmp_path, monkeypatch):
    from shelfmark.operators import search_index

    monkeypatch.setattr(search_index, "FILE_ROWS", 10, raising=False)
    index = search_index.SearchIndex(spark, str(tmp_path))
    index.update(spark.range(100).selectExpr("id", "'same word word' as text"), "id", ["text"], 0)
    files = list((tmp_path / "postings").glob("version=0/bucket=*/*.parquet"))
    assert len(files) > 4 and len({f.parent for f in files}) == 2
    assert {(r["hits"], r["length"]) for r in index.postings.read().filter("word = 'word'").collect()} == {(2, 3)}
    assert index.search(["same", "wor"]).count() == 100


def test_sheets_are_read_within_their_rows(spark):
    from shelfmark.sources.sheets import cue_tracks

    text = 'PERFORMER Band\nTITLE All\nFILE "a.wav" WAVE\nTRACK 01 AUDIO\nTITLE One\nINDEX 00 00:01:00\nINDEX 01 00:02:00\nTRACK x\nFILE "b.wav" WAVE\nTRACK 01 AUDIO\nPERFORMER Guest\nINDEX 01 00:00:00'
    found = cue_tracks(spark.createDataFrame([(1, text), (2, None), (3, "TITLE none")], "id int, text string"), "id")
    assert "Exchange" not in _plan(found)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, 1, 1, 1, "One", "Band", "All", "a.wav", 1000, 2000), (1, 2, 1, 2, None, "Guest", "All", "b.wav", None, 0)]


def test_songs_are_dealt_out_before_clients_are_asked(spark):
    from shelfmark.plans import playing

    assert "REPARTITION_BY_NUM" in _plan(playing.play_decisions(Views(spark, SF)))


def test_songs_of_genres_stay_in_small_pieces(spark):
    """Pieces that Spark puts together are as large as it reads at once, and distinct counts hold many times that."""
    assert "REPARTITION_BY_NUM" in _plan(albums.genres(Views(spark, SF)))
