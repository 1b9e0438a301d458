"""Reads by id, artist, folder and list; tags, playlists, hidden records and numbered names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import artist_name, names_in_tag
from shelfmark.operators import identity, issues, lists, nodes, segments, tags
from shelfmark.plans import live, people, upkeep
from shelfmark.plans.albums import first_values
from shelfmark.plans.library import FILES_SQL, Library
from shelfmark.plans.views import Views
from shelfmark.sources.kept import stage
from shelfmark.sources.tables import TABLES_SQL


def told(v: Views, records: DataFrame) -> DataFrame:
    """Some of ``v.records`` with songs, length and genre; of the tracks only their own albums' are grouped."""
    albums = v.grouped.join(records.select("group_id"), "group_id", "left_semi").select("id", "group_id")
    return v.told(records, albums, v.tracks(albums.select("id")))


def albums_by_id(v: Views, ids: DataFrame) -> DataFrame:
    """Records of ``ids`` (id), hidden ones too."""
    return told(v, v.records.join(ids.select("id"), "id", "left_semi"))


def albums_of_artist(v: Views, ids: DataFrame) -> DataFrame:
    """Records of the artists ``ids`` (artist_id), where they are shown."""
    return told(v, v.records.filter("junk_reason IS NULL").join(ids.select("artist_id"), "artist_id", "left_semi"))


def songs_of(v: Views, tracks: DataFrame) -> DataFrame:
    return v.songs(tracks)


def songs_by_id(v: Views, ids: DataFrame) -> DataFrame:
    """Songs of ``ids`` (id): only the lines of their albums are read into tracks."""
    albums = ids.select(F.floor(F.col("id") / 10).cast("bigint").alias("id")).distinct()
    return v.songs(v.tracks(albums).join(ids.select("id"), "id", "left_semi"))


def songs_in_folder(v: Views, folders: DataFrame) -> DataFrame:
    """Songs whose file lies in one of ``folders`` (root_id, folder_rel_path) itself."""
    files = v.file.join(folders, ["root_id", "folder_rel_path"], "left_semi").select(F.col("id").alias("file_id"))
    return v.songs(v.track.join(files, "file_id", "left_semi"))


def songs_of_playlist(v: Views, entries: DataFrame) -> DataFrame:
    """Songs of ``entries`` (list_id, position, track_id), one row an entry; entries without a song are absent."""
    songs = songs_by_id(v, entries.select(F.col("track_id").alias("id")).distinct())
    return entries.join(songs, F.col("track_id") == songs["id"]).drop("track_id")


def discs_of_album(v: Views, ids: DataFrame) -> DataFrame:
    """All discs of the records that the albums ``ids`` (id) belong to, in order of their place."""
    groups = v.grouped.join(ids.select("id"), "id", "left_semi").select("group_id").distinct()
    return v.grp.join(groups, "group_id", "left_semi").select("rep_id", "rn", "id", "disc_number", "title", "rel_path")


_RECORD = ["id", "title", "artist_id", "artist_name", "year", "song_count", "duration_ms", "genre"]
_SONG = ["id", "album_id", "ordinal", "duration_ms", "rel_path", "album_title", "artist_name"]


def _entries(v: Views) -> DataFrame:
    c = v.read("conversations")
    return c.select(F.col("conv_id").alias("list_id"), F.col("turn").alias("position"), ((F.col("conv_id") * 31 % 1500) * 10 + F.col("turn") + 1).alias("track_id"))


def own_folders(v: Views) -> DataFrame:
    """Each artist's folders at the top of the roots: those of its very name before those that go on after it."""
    x = Library(v)
    keys = artist_name("top")["key"]
    top = nodes.tops(x.tree, x.artists).filter("owner IS NOT NULL").join(x.artists.select(F.col("key").alias("owner"), "id"), "owner")
    return top.select(F.col("id").alias("artist_id"), "root_id", "top", (keys == F.col("owner")).alias("exact"))


def _read_tags(v: Views) -> DataFrame:
    """Tags of parts as a file holds them: two artists, a title in both blocks, a year in the older alone."""
    p = F.col("p_partkey")
    tag = lambda seq, name, value, older, on: F.when(on, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), value.alias("value"), F.lit(older).alias("older")))
    said = F.array(
        tag(0, "artist", F.col("p_brand"), False, p % 2 == 0), tag(1, "artist", F.concat("p_name", F.lit(" & x, y")), False, p % 3 == 0), tag(2, "title", F.col("p_name"), False, p % 5 > 0),
        tag(3, "title", F.col("p_type"), True, F.lit(True)), tag(4, "date", F.lit("1999"), True, p % 4 == 0), tag(5, "genre", F.concat(F.lit("("), (p % 6).cast("string"), F.lit(")x")), True, F.lit(True)), tag(6, "artist", F.lit("old"), True, F.lit(True)),
    )
    return v.read("part").select(p.alias("file_id"), F.inline(F.array_compact(said)))


def placed_tags(v: Views) -> DataFrame:
    return tags.placed(_read_tags(v))


GENRES = ["Blues", "Classic Rock", "Country", "Dance"]


def resolved_genres(v: Views) -> DataFrame:
    """Genres of tags; a code beyond the list that is asked with stays as it is."""
    g = tags.placed(_read_tags(v)).filter("name = 'genre'")
    return g.groupBy(tags.resolved_genre("value", GENRES).alias("genre")).agg(F.count("*").alias("files"))


def tag_names(v: Views) -> DataFrame:
    return tags.placed(_read_tags(v)).filter("name = 'artist'").select("file_id", "position", F.array_join(names_in_tag("value"), "|").alias("names"))


#: What listings show of a file's tags, by tag.
SHOWN = {
    "genre": "genre", "artist": "track_artist", "itunesadvisory": "advisory_itunes", "rtng": "advisory_mp4", "replaygain_track_gain": "rg_track_gain", "replaygain_album_gain": "rg_album_gain",
    "replaygain_track_peak": "rg_track_peak", "replaygain_album_peak": "rg_album_peak",
}


def shown_tags(v: Views) -> DataFrame:
    """The eight values of each part that listings show: its genres and artist, advisories of some, gains that its price stands for, blank ones passed over."""
    p, price = F.col("p_partkey"), F.col("p_retailprice").cast("int").cast("string")
    tag = lambda on, name, value, position: F.when(on, F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(position).alias("position")))
    more = F.array(
        tag(p % 3 == 0, "itunesadvisory", (p % 4).cast("string"), 0), tag(p % 4 == 0, "rtng", F.lit(" 4 "), 0), tag(p % 2 == 0, "replaygain_track_gain", F.lit(" \t"), 0), tag(F.lit(True), "replaygain_track_gain", F.concat("p_size", F.lit(" dB")), 1),
        tag(p % 5 == 0, "replaygain_album_gain", F.concat(price, F.lit(" dB")), 0), tag(F.lit(True), "replaygain_track_peak", price, 0), tag(p % 7 == 0, "replaygain_album_peak", F.lit("1.0"), 0), tag(p % 7 == 0, "replaygain_album_peak", F.lit("2.0"), 1),
    )
    every = v.file_tag.unionByName(v.read("part").select(p.alias("file_id"), F.inline(F.array_compact(more))))
    return first_values(every, SHOWN)


def stale_readings(v: Views) -> DataFrame:
    files = v.read("part").select(F.when(F.col("p_partkey") % 3 > 0, "audio").otherwise("cue").alias("kind"), F.when(F.col("p_size") > 3, F.col("p_size") % 4).alias("tags_method"))
    return tags.stale(files, v.read("supplier").select((F.col("s_suppkey") % 5).alias("probe_method")), 2, 3)


def _list_entries(v: Views) -> DataFrame:
    """Lines of conversations as entries of playlist files; every fifth a stream, the list of an even number within one folder."""
    c, t = F.col("conv_id"), F.col("turn")
    file = ((c * 5 + t * 3) % 400).cast("string")
    folder = F.when(c % 2 == 0, F.lit("one")).otherwise(F.concat(F.lit("F"), (t % 2).cast("string")))
    return v.read("conversations").select((c % 3).alias("root_id"), c.alias("list_id"), t.alias("position"), F.when(t % 5 != 4, F.concat(folder, F.lit("/"), file, F.lit(".FLAC"))).alias("path"))


def _list_files(v: Views) -> DataFrame:
    p = F.col("p_partkey")
    folder = F.array(F.lit("one"), F.lit("f0"), F.lit("f1"))
    roots = F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))
    return v.read("part").filter(p % 7 != 0).select(p.alias("file_id"), F.explode(folder).alias("f")).select("file_id", F.explode(roots).alias("root_id"), "f").select("file_id", "root_id", F.concat("f", F.lit("/"), F.col("file_id").cast("string"), F.lit(".flac")).alias("rel_path"))


def playlist_verdicts(v: Views) -> DataFrame:
    return lists.imported(_list_entries(v), _list_files(v))[0]


def imported_entries(v: Views) -> DataFrame:
    return lists.imported(_list_entries(v), _list_files(v))[1]


def hidden_records(v: Views) -> DataFrame:
    """Hidden albums, with whether a hand or a scan hid them: marks are every third customer's folders of orders."""
    marks = v.album.filter("id % 3 = 0").select("root_id", "rel_path", F.when(F.col("id") % 2 == 0, "junk").otherwise("fine").alias("verdict"))
    by_hand = marks.filter("verdict = 'junk'").select("root_id", "rel_path", F.lit("hand").alias("source"))
    rows = v.album.filter("junk_reason IS NOT NULL").join(by_hand, ["root_id", "rel_path"], "left")
    return rows.join(v.root.select(F.col("id").alias("root_id"), F.col("path").alias("root_path")), "root_id").select("root_path", "rel_path", "title", "junk_reason", F.coalesce("source", F.lit("scan")).alias("source"))


def numbered_records(v: Views) -> DataFrame:
    """Albums and releases of parts' names, with notes that some titles say already."""
    p = F.col("p_partkey")
    note = F.when(p % 4 == 0, " (Cass)").when(p % 4 == 1, " (CD, 2001)").otherwise("")
    title = F.concat("p_name", F.when(p % 8 == 0, " (Cass)").when(p % 3 == 0, " (7)").otherwise(""))
    rows = v.read("part").select(F.when(p % 2 == 0, "album").otherwise("release").alias("kind"), p.alias("id"), F.when(p % 10 > 0, (p % 3)).alias("artist_id"), title.alias("title"), F.concat("p_type", F.lit("/x"), p.cast("string"), note).alias("rel_path"))
    return lists.numbered(rows)


def stage_issues(v: Views) -> DataFrame:
    """The ledger after a scan, a playlist import and the artists' stage: an older ledger's rows of these go, those of other stages stay."""
    artists = stage(people.credited_artists(v), "artists")
    found = issues.together(issues.of_artists(artists, identity.twins(artists)), issues.of_playlists(playlist_verdicts(v)), issues.of_scan(live.change_feed(v)))
    old = issues.issue(v.read("supplier"), "tags", "tag-unreadable", "error", F.col("s_name")).unionByName(issues.issue(v.read("supplier"), "scan", "file-unsettled", "info", F.col("s_name")))
    return issues.taken_in(old, found, ["artists", "playlists", "scan"])


def _parts_with_sheets(v: Views) -> tuple[DataFrame, DataFrame]:
    """Parts as audio files; a third has a sheet that names its stem, half of these another with its very name."""
    p, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    folder = F.concat("p_type", F.lit("/"), "p_brand")
    part = v.read("part")
    audio = part.select(p.alias("file_id"), folder.alias("folder"), F.concat(F.lit("p"), n, F.lit(".wav")).alias("name"), F.col("p_type").alias("album"), F.when(p % 4 == 0, F.col("p_name")).alias("tag_title"), F.lit(9000).alias("duration_ms"))
    named = F.when(p % 3 == 0, F.array(F.struct(p.alias("sheet_id"), F.concat(F.lit("P"), n, F.lit(".ape")).alias("reference")), F.struct((p + 100_000).alias("sheet_id"), F.concat(F.lit("P"), n, F.lit(".WAV")).alias("reference"))))
    sheets = part.select(p.alias("p"), folder.alias("folder"), F.inline(named)).filter("sheet_id = p OR p % 2 = 0").select("sheet_id", "folder", F.concat("folder", F.lit("/"), F.col("sheet_id").cast("string"), F.lit(".cue")).alias("rel_path"), "reference")
    return sheets, audio


def planned_songs(v: Views) -> DataFrame:
    """Songs of all parts; each sheet has three."""
    sheets, audio = _parts_with_sheets(v)
    k = F.explode(F.sequence(F.lit(1), F.lit(3)))
    tracks = sheets.select("sheet_id", F.col("reference").alias("file"), k.alias("place")).select("sheet_id", "file", "place", F.when(F.col("place") != 2, F.concat(F.lit("Song "), F.col("place").cast("string"))).alias("title"), ((F.col("place") - 1) * 1000).alias("start_ms"))
    return segments.songs(tracks, sheets, audio)


def sheet_issues(v: Views) -> DataFrame:
    """What the sheets' stage could not settle: sheets that speak for no part, and songs whose sheet repeats a number or gives no start."""
    tracks = upkeep.cue_tracks(v)
    tracks = tracks.withColumn("start_ms", F.when(F.col("album_id") % 9 > 0, F.col("start_ms")))
    return issues.of_sheets(segments.unmatched(*_parts_with_sheets(v)), tracks, "album_id")


def queries() -> dict:
    q = lambda text: TABLES_SQL + text
    record, song = ", ".join(_RECORD), ", ".join(_SONG)
    tagged = """with r as (
  select p_partkey as file_id, unnest([{'seq': 0, 'name': 'artist', 'value': p_brand, 'older': false, 'said': p_partkey % 2 = 0}, {'seq': 1, 'name': 'artist', 'value': p_name || ' & x, y', 'older': false, 'said': p_partkey % 3 = 0}, {'seq': 2, 'name': 'title', 'value': p_name, 'older': false, 'said': p_partkey % 5 > 0},
    {'seq': 3, 'name': 'title', 'value': p_type, 'older': true, 'said': true}, {'seq': 4, 'name': 'date', 'value': '1999', 'older': true, 'said': p_partkey % 4 = 0}, {'seq': 5, 'name': 'genre', 'value': '(' || p_partkey % 6 || ')x', 'older': true, 'said': true}, {'seq': 6, 'name': 'artist', 'value': 'old', 'older': true, 'said': true}], recursive := true) from part
), s as (select * from r where said), t as (
  select file_id, name, value, row_number() over (partition by file_id, name order by seq) - 1 as position from s where not older or not exists (select 1 from s n where n.file_id = s.file_id and n.name = s.name and not n.older))
"""
    entry = """with e as (
  select conv_id % 3 as root_id, conv_id as list_id, turn as position, case when turn % 5 <> 4 then case when conv_id % 2 = 0 then 'one' else 'f' || turn % 2 end end as folder, (conv_id * 5 + turn * 3) % 400 as n from conversations
), m as (select *, folder is not null and (n % 7 = 0 or n not in (select p_partkey from part)) as missing from e
), l as (select root_id, list_id, count(*) as entries, count(distinct folder) as folders, count(*) filter (missing) as missing, case when count(distinct folder) > 1 then 'curated' else 'redundant' end as verdict from m group by 1, 2)
"""
    named = """with n as (
  select case when p_partkey % 2 = 0 then 'album' else 'release' end as kind, p_partkey as id, p_partkey % 3 as artist, p_name || case when p_partkey % 8 = 0 then ' (Cass)' else '' end as base,
    case when p_partkey % 4 = 0 and p_partkey % 8 <> 0 then 'Cass' when p_partkey % 4 = 1 then 'CD, 2001' else '' end as note, p_type || '/x' || p_partkey || case p_partkey % 4 when 0 then ' (Cass)' when 1 then ' (CD, 2001)' else '' end as rel_path from part where p_partkey % 10 > 0)
"""
    return {
        "albums_by_id": (lambda v: albums_by_id(v, v.album.filter("id % 50 = 1").select("id")).select(*_RECORD, "junk_reason"), q(f"select {record}, junk_reason from album_select where id % 50 = 1")),
        "albums_of_artist": (lambda v: albums_of_artist(v, v.artist.filter("id < 3").select(F.col("id").alias("artist_id"))).select(*_RECORD), q(f"select {record} from album_select where artist_id < 3 and junk_reason is null")),
        "songs_by_id": (lambda v: songs_by_id(v, v.album.filter("id % 40 = 2").select((F.col("id") * 10 + 1).alias("id"))).select(*_SONG, "genre"), q(f"select {song}, genre from song_select where id % 10 = 1 and album_id % 40 = 2")),
        "songs_in_folder": (lambda v: songs_in_folder(v, v.file.filter("id % 7 = 3").select((F.col("id") % 2).alias("root_id"), "folder_rel_path").distinct()).select(*_SONG), q(f"select {song} from song_select s where exists (select 1 from file f join file g on g.root_id = f.id % 2 and g.folder_rel_path = f.folder_rel_path join track t on t.file_id = g.id where f.id % 7 = 3 and t.id = s.id)")),
        "songs_of_playlist": (lambda v: songs_of_playlist(v, _entries(v)).select("list_id", "position", *_SONG), q(f"select c.conv_id as list_id, c.turn as position, {song} from conversations c join song_select s on s.id = (c.conv_id * 31 % 1500) * 10 + c.turn + 1")),
        "discs_of_album": (lambda v: discs_of_album(v, v.album.filter("id % 30 = 4").select("id")), q("select rep_id, rn, id, disc_number, title, rel_path from grp where group_id in (select group_id from grp where id % 30 = 4)")),
        "own_folders": (own_folders, FILES_SQL + "select a.id as artist_id, root_id, top, trim(regexp_replace(regexp_replace(lower(top), '^the ', ''), '[^a-z0-9]+', ' ', 'g')) = owner as exact from node join artist_key a on a.key = owner"),
        "placed_tags": (placed_tags, tagged + "select file_id, name, value, position from t"),
        "resolved_genres": (resolved_genres, tagged + "select case value when '(0)x' then 'Blues' when '(1)x' then 'Classic Rock' when '(2)x' then 'Country' when '(3)x' then 'Dance' else value end as genre, count(*) as files from t where name = 'genre' group by 1"),
        "tag_names": (tag_names, tagged + "select file_id, position, case when value like '% & x, y' then replace(replace(value, ' & ', '|'), ', ', '|') else value end as names from t where name = 'artist'"),
        "shown_tags": (shown_tags, q("select p_partkey as file_id, g.value as genre, p_brand as track_artist, case when p_partkey % 3 = 0 then cast(p_partkey % 4 as varchar) end as advisory_itunes, case when p_partkey % 4 = 0 then '4' end as advisory_mp4, p_size || ' dB' as rg_track_gain, case when p_partkey % 5 = 0 then cast(p_retailprice - 0.4999999 as int) || ' dB' end as rg_album_gain, cast(cast(p_retailprice - 0.4999999 as int) as varchar) as rg_track_peak, case when p_partkey % 7 = 0 then '1.0' end as rg_album_peak from part left join (select file_id, trim(value) as value, row_number() over (partition by file_id order by position) as k from file_tag where name = 'genre' and trim(value) <> '') g on g.file_id = p_partkey and g.k = 1")),
        "stale_readings": (stale_readings, "select (select count(*) from part where p_partkey % 3 > 0 and p_size > 3 and p_size % 4 <> 2) as tags, (select count(*) from supplier where s_suppkey % 5 <> 3) as probes"),
        "playlist_verdicts": (playlist_verdicts, entry + "select root_id, list_id, entries, folders, missing, verdict from l"),
        "imported_entries": (imported_entries, entry + "select root_id, list_id, row_number() over (partition by root_id, list_id order by position) - 1 as position, n as file_id from m where folder is not null and not missing and list_id in (select list_id from l where verdict = 'curated')"),
        "hidden_records": (hidden_records, q("select r.path as root_path, a.rel_path, a.title, a.junk_reason, case when a.id % 6 = 0 then 'hand' else 'scan' end as source from album a join root r on r.id = a.root_id where a.junk_reason is not null")),
        "planned_songs": (planned_songs, """select p_partkey as file_id, case when p_partkey % 6 = 0 then p_partkey + 100000 else p_partkey end as sheet_id, k as ordinal, case when k = 2 then 'p' || p_partkey else 'Song ' || k end as title, case when k = 2 then 'name' else 'cue' end as title_source, (k - 1) * 1000 as start_ms, case when k = 3 then 9000 else k * 1000 end as end_ms
          from part, (select unnest([1, 2, 3]) as k) where p_partkey % 3 = 0 union all select p_partkey, null, 1, case when p_partkey % 4 = 0 then p_name else 'p' || p_partkey end, case when p_partkey % 4 = 0 then 'tag' else 'name' end, null, null from part where p_partkey % 3 > 0"""),
        "stage_issues": (stage_issues, f"""select 'tags' as stage, 'tag-unreadable' as kind, 'error' as severity, cast(null as bigint) as root_id, cast(null as varchar) as rel_path, s_name as detail from supplier
          union all select 'artists', kind, 'warn', null, null, detail from ({people.PEOPLE_SQL} select 'artist-homonym' as kind, base as detail from artist where homonym and key = base union all select 'artist-transliteration', latin || ' / ' || key from twin)
          union all select 'playlists', 'playlist-entries-missing', 'warn', root_id, null, list_id || ': ' || missing from ({entry} select * from l where verdict = 'curated' and missing > 0)
          union all select 'scan', case state when 'held' then 'file-unsettled' else 'folder-closed' end, case state when 'held' then 'info' else 'error' end, root_id, rel_path, state from ({live.FEED_SQL} select * from feed where state in ('held', 'closed'))"""),
        "sheet_issues": (sheet_issues, TABLES_SQL.replace("with ", "with recursive ", 1) + """, n as (select album_id, (ordinal - 1) % 3 + 1 as track, row_number() over (partition by album_id order by ordinal) as place from track),
          r as (select album_id, place, track, [track] as taken from n where place = 1 union all select n.album_id, n.place, n.track, list_append(taken, case when list_contains(taken, n.track) then list_min(list_filter(range(n.place, 2 * n.place), lambda x: not list_contains(taken, x))) else n.track end) from r join n on n.album_id = r.album_id and n.place = r.place + 1)
          select 'cues' as stage, 'cue-file-missing' as kind, 'warn' as severity, cast(null as bigint) as root_id, p_type || '/' || p_brand || '/' || p_partkey || '.cue' as rel_path, 'P' || p_partkey || '.ape' as detail from part where p_partkey % 6 = 0
          union all select 'cues', 'cue-number-mended', 'info', null, null, album_id || ': ' || track from r where taken[place] <> track union all select 'cues', 'cue-start-missing', 'error', null, null, album_id || ': ' || place from n where album_id % 9 = 0"""),
        "numbered_records": (numbered_records, named + "select kind, id, base || ' (' || k || ')' as title from (select *, count(*) over (partition by artist, base, note) as c, row_number() over (partition by artist, base, note order by rel_path, id) as k from n) where c > 1"),
    }
