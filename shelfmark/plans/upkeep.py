"""Names, sheets, search, keyed writes and listings by rule, each with its counterpart in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import expressions as X
from shelfmark.functions import names
from shelfmark.operators import keyed, search
from shelfmark.operators.search_index import SearchIndex
from shelfmark.plans.views import Views
from shelfmark.sources import sheets
from shelfmark.sources.kept import shared_folder
from shelfmark.sources.tables import TABLES_SQL


def _q(text: str) -> str:
    return TABLES_SQL + text


def numbers(v: Views) -> DataFrame:
    """Sizes and rates of songs whose price stands for a bitrate."""
    rate, ms = F.round(F.col("l_extendedprice")).cast("bigint"), F.col("l_quantity").cast("bigint") * 1000
    rows = v.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rate.alias("rate"), ms.alias("ms"))
    return rows.groupBy("l_orderkey").agg(F.sum(X.cut_size("rate", "ms")).alias("bytes"), F.sum(X.kilobits("rate")).alias("kbit"), F.max(X.bitrate_of("rate", "ms")).alias("rate"), F.sum(X.seconds("ms")).alias("seconds"))


def _credited(v: Views) -> DataFrame:
    p = F.col("p_partkey") % 7
    c = lambda *x: F.concat(*(F.col(y) if y.startswith("p_") else F.lit(y) for y in x))
    text = F.when(p == 0, c("The ", "p_name")).when(p == 1, c("p_name", ", The (", "p_brand", ")")).when(p == 2, c("“", "p_name", "” – Café & ", "p_brand")).when(p == 3, c("R.E.", "p_name", "  feat. ", "p_brand", " x ", "p_type"))
    text = text.when(p == 4, c("& ", "p_name", " +", "p_brand", "+")).when(p == 5, c("[", "p_name", "]")).otherwise(c("p_name", "/", "p_brand", " vs ", "p_type", " and "))
    return v.read("part").select(F.col("p_partkey").alias("id"), text.alias("text"))


_CREDITED = """with raw as (select p_partkey as id, case p_partkey % 7 when 0 then 'The ' || p_name when 1 then p_name || ', The (' || p_brand || ')' when 2 then '“' || p_name || '” – Café & ' || p_brand
  when 3 then 'R.E.' || p_name || '  feat. ' || p_brand || ' x ' || p_type when 4 then '& ' || p_name || ' +' || p_brand || '+' when 5 then '[' || p_name || ']' else p_name || '/' || p_brand || ' vs ' || p_type || ' and' end as text from part)"""


def artist_names(v: Views) -> DataFrame:
    return _credited(v).select("id", names.artist_name("text").alias("n")).select("id", "n.*")


_FOLD = r"strip_accents(trim(regexp_replace(regexp_replace(case when lower({0}) = 'the' then '' when regexp_matches(lower({0}), '^the\s') then regexp_replace(lower({0}), '^the\s+', '') else regexp_replace(lower({0}), ',\s*the$', '') end, '\.(\S)', '\1', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
ARTIST_SQL = _CREDITED + r""", t as (select id, trim(regexp_replace(translate(text, '“”–', '""-'), '\s+', ' ', 'g')) as name from raw
), b as (select *, trim(regexp_replace(regexp_replace(name, '[(\[][^)\]]*[)\]]', ' ', 'g'), '\s+', ' ', 'g')) as bare, regexp_extract(name, '[(\[]([^)\]]*)[)\]]', 1) as inner_ from t)
select id, name, """ + _FOLD.format("name") + r""" as folded, """ + _FOLD.format("(case when bare = '' then inner_ else bare end)") + r""" as key,
  case when regexp_matches(lower(name), '^the\s') then regexp_replace(name, '^[Tt]he\s+', '') || ', The' else name end as sort_key, case when bare <> '' and inner_ <> '' then inner_ end as stripped from b"""


def credits(v: Views) -> DataFrame:
    parts = names.split_credit("text")
    return _credited(v).select("id", F.array_join(F.transform(parts, lambda x: x["name"]), "|").alias("names"), F.array_join(F.transform(parts, lambda x: x["join_phrase"]), "|").alias("phrases"))


CREDIT_SQL = _CREDITED + r"""select id,
  case id % 7 when 0 then text when 1 then text when 2 then regexp_extract(text, '^(.*) & ', 1) || '|' || regexp_extract(text, ' & (.*)$', 1) when 3 then regexp_extract(text, '^(.*)  feat', 1) || '|' || regexp_extract(text, 'feat\. (\S+(?: \S+)*?) x ', 1) || '|' || regexp_extract(text, 'feat\. .*? x (.*)$', 1)
    when 4 then regexp_extract(text, '^(.*) \+', 1) || '|' || regexp_extract(text, ' \+(.*)$', 1) when 5 then text else regexp_extract(text, '^([^/]*)/', 1) || '|' || regexp_extract(text, '/(.*?) vs ', 1) || '|' || regexp_extract(text, ' vs (.*)$', 1) end as names,
  case id % 7 when 2 then '| & ' when 3 then '|  feat. | x ' when 4 then '| +' when 6 then '|/| vs ' else '' end as phrases from raw"""


def _sheet(v: Views) -> DataFrame:
    """A cue sheet for each album with songs, each song a minute and some frames after the one before; from the fourth on in a second file, numbered anew."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    n = F.col("ordinal")
    song = F.concat(F.when(n == 4, F.lit('FILE "b.wav" WAVE\r\n')).otherwise(""), F.lit("  TRACK "), two((n - 1) % 3 + 1), F.lit(' AUDIO\r\n    TITLE "Song '), n.cast("string"), F.lit('"\r\n'), F.when(n % 2 == 0, F.lit("    PERFORMER Guest\r\n")).otherwise(""), F.lit("    INDEX 00 "), two(n), F.lit(":00:00\r\n    INDEX 01 "), two(n), F.lit(":01:"), two(n * 5), F.lit("\r\n"))
    songs = v.track.groupBy("album_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", song.alias("x")))), lambda s: s["x"]), "").alias("songs"))
    return songs.select("album_id", F.concat(F.lit('﻿PERFORMER "Band"\r\nTITLE "Album"\r\nREM GENRE Rock\r\nFILE "a b.wav" WAVE\r\n'), "songs").alias("text"))


def cue_tracks(v: Views) -> DataFrame:
    return sheets.cue_tracks(_sheet(v), "album_id")


def cue_sheets(v: Views) -> DataFrame:
    return cue_tracks(v).drop("ordinal")


def playlist_files(v: Views) -> DataFrame:
    line = F.when(F.col("turn") % 4 == 0, F.lit("#EXTINF:1,x\n")).otherwise("")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"../up/'), F.col("turn").cast("string"), F.lit('.flac"'))).when(F.col("turn") % 3 == 1, F.concat(F.lit("http://radio/"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("sub\\./"), F.col("turn").cast("string"), F.lit(".mp3")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(line, said).alias("x")))), lambda s: s["x"]), "\n\n")
    lists = v.read("conversations").groupBy("conv_id").agg(text.alias("text")).withColumn("folder", F.concat(F.lit("lists/l"), F.col("conv_id").cast("string")))
    return sheets.playlist_entries(lists, "conv_id", "folder")


def _searched(v: Views) -> DataFrame:
    """What search looks into: a song's title, its artist and its record."""
    g = v.boxed.select(F.col("id").alias("album_id"), "group_id", "rep_id", F.coalesce("artist_id", "b_artist").alias("by"), F.coalesce("b_title", "title").alias("record"))
    s = v.track.join(v.file.select(F.col("id").alias("file_id"), "rel_path"), "file_id").join(g, "album_id", "left")
    s = s.join(v.artist.select(F.col("id").alias("a_id"), F.col("name").alias("artist")), F.col("by") == F.col("a_id"), "left")
    return s.select("id", "group_id", "rep_id", F.col("by").alias("artist_id"), F.col("rel_path").alias("title"), F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("record", F.lit("")).alias("album"))


WORDS = ["customer", "ec"]


#: The index of each folder of tables, by session: built by the first question, read by those that follow.
_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def song_index(v: Views) -> SearchIndex:
    at = (v.spark.sparkContext.applicationId, v.folder)
    if at not in _INDEXES:
        index = SearchIndex(v.spark, f"{shared_folder(v.spark)}/shelfmark/songs-{uuid.uuid4().hex}")
        index.update(_searched(v), "id", ["title", "artist", "album"], 0)
        _INDEXES[at] = index
    return _INDEXES[at]


def _hits(v: Views) -> DataFrame:
    """Songs that the index finds, with their record and artist."""
    found = song_index(v).search(WORDS).withColumnRenamed("key", "id")
    albums = v.boxed.select(F.col("id").alias("album_id"), "group_id", "rep_id", F.coalesce("artist_id", "b_artist").alias("artist_id"))
    return v.track.select("id", "album_id").join(found, "id").join(albums, "album_id", "left")


def search_songs(v: Views) -> DataFrame:
    return song_index(v).search(WORDS).select(F.col("key").alias("id"), "rank").orderBy(F.round("rank", 9), "id").limit(100).select("id", F.round("rank", 6).alias("rank"))


def search_albums(v: Views) -> DataFrame:
    best = _hits(v).groupBy("group_id").agg(F.min("rep_id").alias("id"), F.min("rank").alias("best"))
    return best.orderBy(F.round("best", 9), "id").limit(100).select("id", F.round("best", 6).alias("rank"))


def search_artists(v: Views) -> DataFrame:
    best = _hits(v).filter("artist_id IS NOT NULL").groupBy("artist_id").agg(F.min("rank").alias("best"))
    return best.orderBy(F.round("best", 9), "artist_id").limit(100).select("artist_id", F.round("best", 6).alias("rank"))


def search_scanned(v: Views) -> DataFrame:
    """The same songs without an index, in two passes over all of them."""
    hits = search.ranked(_searched(v), ["title", "artist", "album"], WORDS)
    return hits.orderBy(F.round("rank", 9), "id").limit(100).select("id", F.round("rank", 6).alias("rank"))


SEARCH_SQL = TABLES_SQL + r""", said as (
  select t.id, g.group_id, g.rep_id, coalesce(g.artist_id, r.artist_id) as artist_id, regexp_extract_all(strip_accents(lower(concat_ws(' ', f.rel_path, coalesce(a.name, ''), coalesce(r.title, g.title, '')))), '[\p{L}\p{N}]+') as w
  from track t join file f on f.id = t.file_id left join grp g on g.id = t.album_id left join release r on r.id = g.release_id left join artist a on a.id = coalesce(g.artist_id, r.artist_id)
), h as (select *, cast(len(w) as double) as n, len(list_filter(w, lambda x: x = 'customer')) as h0, len(list_filter(w, lambda x: starts_with(x, 'ec'))) as h1 from said
), st as (select count(*) as c, avg(n) as long, count(*) filter (h0 > 0) as n0, count(*) filter (h1 > 0) as n1 from h
), k as (select h.*, -greatest(1e-6, ln((c - n0 + 0.5) / (n0 + 0.5))) * h0 * 2.2 / (h0 + 1.2 * (0.25 + 0.75 * n / long)) - greatest(1e-6, ln((c - n1 + 0.5) / (n1 + 0.5))) * h1 * 2.2 / (h1 + 1.2 * (0.25 + 0.75 * n / long)) as rank from h, st where h0 > 0 and h1 > 0)
"""


def probes(v: Views) -> DataFrame:
    """Readings taken anew: only what had failed, or an older method read, is replaced."""
    old = v.read("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("method"), (F.col("p_size") % 2 == 0).alias("ok"), "p_retailprice")
    new = v.read("part").select((F.col("p_partkey") + 10).alias("id"), F.lit(1).alias("method"), F.lit(True).alias("ok"), F.lit(1.0).alias("p_retailprice"))
    return keyed.upsert_where(old, new, ["id"], ~F.col("o.ok") | (F.col("o.method") < F.col("n.method")))


def play_counts(v: Views) -> DataFrame:
    old = v.album.select(F.col("id").alias("album_id"), F.col("id").alias("play_count"), F.lit(None).cast("timestamp").alias("played_at"))
    return keyed.counted_in(old, v.play.select("album_id", F.col("id").alias("seq"), "played_at"), ["album_id"], "seq", "played_at", "play_count")


def players(v: Views) -> DataFrame:
    known = v.artist.select("name", F.col("id").cast("bigint").alias("id"))
    every = keyed.with_new_members(known, v.read("supplier").select(F.col("s_name").alias("name")).union(v.artist.select("name")), "name", "id")
    return every.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("most"))


def first_kept(v: Views) -> DataFrame:
    old = v.read("events").filter("user_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
    return keyed.insert_new(old, v.read("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def exchanged_lists(v: Views) -> DataFrame:
    c = v.read("conversations").select("conv_id", "turn", "role")
    return keyed.replaced_lists(c, c.filter("conv_id % 3 = 0 AND turn = 0").withColumn("role", F.lit("only")), "conv_id")


def swept(v: Views) -> DataFrame:
    """Albums after a scan that saw none with an even id, while some customers' folders were held."""
    rows = v.album.select("root_id", "rel_path", "id")
    held = v.release.filter("year < 2000").select("root_id", F.col("rel_path").alias("folder"))
    return keyed.swept_trees(rows, rows.filter("id % 2 = 1"), held, ["root_id"])


def removed_roots(v: Views) -> DataFrame:
    out = keyed.cascaded({"root": v.root.select("id"), "release": v.release.select("id", "root_id"), "album": v.album.select("id", "release_id", "root_id"), "track": v.track.select("id", "album_id")}, [("release", "root_id", "root"), ("album", "root_id", "root"), ("track", "album_id", "album")], v.root.filter("id = 2").select("id"))
    return out["track"].join(out["album"].select(F.col("id").alias("album_id"), "root_id"), "album_id").groupBy("root_id").agg(F.count("*").alias("songs"))


def exported(v: Views) -> DataFrame:
    """Lists written as documents, read again, and told apart by whether their entries have a place."""
    docs = keyed.documents_of(v.read("conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    placed, skipped = keyed.restored(docs, "conv_id", "array<struct<turn bigint, role string>>", v.read("conversations").filter("turn < 3").select("conv_id", "turn"), ["conv_id", "turn"])
    return placed.withColumn("state", F.lit("placed")).union(skipped.withColumn("state", F.lit("skipped")).select("conv_id", "turn", "role", "state")).groupBy("state", "role").agg(F.count("*").alias("n"))


def stats(v: Views) -> DataFrame:
    """How many rows each table of the catalogue has."""
    tables = {"album": v.album, "artist": v.artist, "file": v.file, "play": v.play, "release": v.release, "root": v.root, "track": v.track}
    out = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionAll(n)
    return out


def event_kinds(v: Views) -> DataFrame:
    return v.read("events").groupBy(F.coalesce("event_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(3)


def asked_in_order(v: Views) -> DataFrame:
    """Records by id in the order in which they were asked for; twice if asked twice, none if unknown.

    Asked are the largest of every 97 albums, backwards, every second of them twice, and one that there is not.
    """
    ids = v.album.filter("id % 97 = 1 AND release_id IS NULL").select("id")
    asked = ids.select((-F.col("id")).alias("place"), "id").union(ids.filter("id % 2 = 0").select("id", "id")).union(v.spark.range(1).select(F.lit(0).cast("bigint"), F.lit(-7).cast("bigint")))
    return asked.join(v.records.select("id", "title", "year"), "id").select("place", "id", "title", "year")


def with_genre(v: Views) -> DataFrame:
    """Files with whether any genre is said of them: EXISTS in the select list."""
    has = v.genre_values.select("file_id").distinct().withColumn("has", F.lit(True))
    return v.file.join(has, F.col("id") == F.col("file_id"), "left").select("id", F.coalesce("has", F.lit(False)).alias("has_genre"))


def files_at(v: Views) -> DataFrame:
    """Releases with the files in their folder or at their very path: one equality for each arm, then both."""
    files = v.file.select("id", F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("folder"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("path"))
    r = v.release.select(F.col("id").alias("release_id"), "rel_path")
    arms = [r.join(files, F.col("rel_path") == F.col(c)).select("release_id", "id") for c in ("folder", "path")]
    return arms[0].union(arms[1]).distinct().groupBy("release_id").agg(F.count("*").alias("files"), F.min("id").alias("first"))


def album_artists(v: Views) -> DataFrame:
    """The one artist all of a release's albums name, or their smallest common ones: sets intersected row after row, as counts."""
    sets = v.album.filter("release_id IS NOT NULL AND artist_id IS NOT NULL").select("release_id", "id", F.explode(F.array_distinct(F.array("artist_id", (F.col("artist_id") + F.col("id") % 2).cast("int")))).alias("artist"))
    albums = v.album.filter("release_id IS NOT NULL AND artist_id IS NOT NULL").groupBy("release_id").agg(F.count("*").alias("albums"))
    common = sets.groupBy("release_id", "artist").agg(F.count("*").alias("n")).join(albums, "release_id").filter("n = albums")
    return common.groupBy("release_id").agg(F.min("artist").alias("artist"), F.count("*").alias("common"))


def homonyms(v: Views) -> DataFrame:
    """Names that several have, numbered by root and path: the first keeps the name."""
    same = Window.partitionBy("year", "artist_id").orderBy("root_id", "rel_path")
    r = v.release.withColumn("place", F.row_number().over(same))
    key = F.concat_ws("-", F.col("artist_id").cast("string"), F.col("year").cast("string"))
    return r.select("id", F.when(F.col("place") > 1, F.concat(key, F.lit("#"), F.col("place").cast("string"))).otherwise(key).alias("key"))


COVER_WORDS = ("front", "cover", "folder", "album")


def covers(v: Views) -> DataFrame:
    """A picture for each folder: by the first word of its name, in the order of what covers are called, else the first by path."""
    said = F.element_at(F.array(*map(F.lit, ("Front scan", "cover-2", "folder", "ALBUM art", "back cover", "discovery"))), (F.col("id") % 6 + 1).cast("int"))
    name = F.concat(said, F.lit(" "), F.col("id").cast("string"), F.lit(".jpg"))
    folder = F.concat("folder_rel_path", F.lit("/"), (F.col("id") % 50).cast("string"))
    pictures = v.file.select("id", folder.alias("folder"), name.alias("name"), F.concat("folder_rel_path", F.lit("/"), name).alias("path"))
    rank = F.array_position(F.array(*map(F.lit, COVER_WORDS)), X.first_word("name"))
    ranked = pictures.withColumn("rank", F.when(rank == 0, len(COVER_WORDS) + 1).otherwise(rank))
    return ranked.groupBy("folder").agg(F.min_by("name", F.struct("rank", "path", "id")).alias("name"))


def naturally_ordered(v: Views) -> DataFrame:
    """Releases' places among those of their artist, with numbers in paths by value."""
    w = Window.partitionBy("artist_id").orderBy(X.natural_key("rel_path"), "id")
    return v.release.select("id", F.row_number().over(w).alias("place"))


def listed(v: Views) -> DataFrame:
    return v.records.orderBy(F.col("year").isNull(), "year", "title", "rel_path", "id").limit(200).select("id", "year", "title")


def earliest(v: Views) -> DataFrame:
    """The earliest of what an artist's releases and records say: one row of both."""
    arms = v.release.select("artist_id", "year", F.lit(0).alias("arm"), "id").unionAll(v.album.filter("artist_id IS NOT NULL").select("artist_id", "year", F.lit(1).alias("arm"), "id"))
    return arms.groupBy("artist_id").agg(F.min(F.struct("year", "arm", "id")).alias("m")).select("artist_id", "m.year", "m.arm", "m.id")


def first_dated(v: Views) -> DataFrame:
    """Albums' years set from the first of their files, by path, that states one; others keep theirs."""
    dated = v.track.join(v.file.select(F.col("id").alias("file_id"), "rel_path"), "file_id").withColumn("said", X.year_of((F.lit(900) + F.col("file_id") % 400).cast("string"))).filter("said IS NOT NULL")
    first = dated.groupBy("album_id").agg(F.min_by("said", F.struct("rel_path", "file_id")).alias("said"))
    return v.album.join(first, F.col("id") == F.col("album_id"), "left").select("id", F.coalesce("said", "year").alias("year"))


def file_matches(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """Each of ``wanted`` (id, ``on``, reference) with the file of ``have`` (file_id, ``on``, name, rel_path) that it means: score 3 for an equal name, 2 for an equal stem, letters of either case; the earliest path on a tie."""
    named = have.select(*on, "file_id", "rel_path", F.lower("name").alias("name"), F.lower(X.stem("name")).alias("stem"))
    asked = wanted.select("id", *on, F.lower("reference").alias("name"), F.lower(X.stem("reference")).alias("stem"))
    best = lambda key: named.groupBy(*on, key).agg(F.min(F.struct("rel_path", "file_id")).alias(f"by_{key}"))
    met = asked.join(best("name"), [*on, "name"], "left").join(best("stem"), [*on, "stem"], "left")
    found = met.select("id", F.coalesce("by_name", "by_stem").alias("f"), F.when(F.col("by_name").isNotNull(), 3).otherwise(2).alias("score"))
    return found.filter("f IS NOT NULL").select("id", "f.file_id", "score")


def matched_cues(v: Views) -> DataFrame:
    """The file that each record's sheet names, among the files of its root."""
    wanted = v.album.select("id", (F.col("id") % 5).alias("root_id"), F.concat(F.lit("N"), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 3 == 0, ".WAV").otherwise(".ape")).alias("reference"))
    have = v.file.select("root_id", "rel_path", F.col("id").alias("file_id"), F.concat(F.lit("n"), (F.col("id") % 9).cast("string"), F.when(F.col("id") % 2 == 1, ".wav").otherwise(".flac")).alias("name"))
    return file_matches(wanted, have, ["root_id"])


def queries() -> dict:
    s = SEARCH_SQL
    return {
        "numbers": (numbers, "select l_orderkey, cast(sum(floor(rate * ms / 8000 + 0.5)) as bigint) as bytes, cast(sum(floor(rate / 1000 + 0.5)) as bigint) as kbit, cast(max(case when ms > 0 then floor(rate * 8000 / ms + 0.5) end) as bigint) as rate, cast(sum(floor(ms / 1000 + 0.5)) as bigint) as seconds from (select l_orderkey, cast(round(l_extendedprice) as double) as rate, cast(cast(l_quantity as bigint) * 1000 as double) as ms from lineitem) group by 1"),
        "artist_names": (artist_names, ARTIST_SQL),
        "credits": (credits, CREDIT_SQL),
        "cue_sheets": (cue_sheets, _q("select album_id, cast(row_number() over w as int) as place, cast((ordinal - 1) % 3 + 1 as int) as track, 'Song ' || ordinal as title, case when ordinal % 2 = 0 then 'Guest' else 'Band' end as performer, 'Album' as sheet_title, case when ordinal >= 4 and bool_or(ordinal = 4) over (partition by album_id) then 'b.wav' else 'a b.wav' end as file, cast(ordinal * 60000 as bigint) as pregap_ms, cast(ordinal * 60000 + 1000 + floor(ordinal * 5 * 1000 / 75.0 + 0.5) as bigint) as start_ms from track window w as (partition by album_id order by ordinal)")),
        "playlist_files": (playlist_files, r"select conv_id, row_number() over (partition by conv_id order by turn) - 1 as position, case turn % 3 when 0 then '../up/' || turn || '.flac' when 1 then 'http://radio/' || turn else 'sub\./' || turn || '.mp3' end as entry, case turn % 3 when 0 then 'lists/up/' || turn || '.flac' when 2 then 'lists/l' || conv_id || '/sub/' || turn || '.mp3' end as path from conversations"),
        "search_songs": (search_songs, s + "select id, round(rank, 6) as rank from k order by round(rank, 9), id limit 100"),
        "search_scanned": (search_scanned, s + "select id, round(rank, 6) as rank from k order by round(rank, 9), id limit 100"),
        "search_albums": (search_albums, s + "select id, round(best, 6) as rank from (select min(rep_id) as id, min(rank) as best from k group by group_id) order by round(best, 9), id limit 100"),
        "search_artists": (search_artists, s + "select artist_id, round(best, 6) as rank from (select artist_id, min(rank) as best from k where artist_id is not null group by 1) order by round(best, 9), artist_id limit 100"),
        "upsert_where": (probes, "with o as (select p_partkey as id, p_size % 3 as method, p_size % 2 = 0 as ok, p_retailprice from part), n as (select p_partkey + 10 as id, 1 as method, true as ok, 1.0::double as p_retailprice from part) select coalesce(o.id, n.id) as id, case when t then n.method else o.method end as method, case when t then n.ok else o.ok end as ok, case when t then n.p_retailprice else o.p_retailprice end as p_retailprice from (select o.id as oid, n.id as nid, o.id is null or (n.id is not null and (not o.ok or o.method < n.method)) as t from o full join n on o.id = n.id) j left join o on o.id = j.oid left join n on n.id = j.nid"),
        "play_counts": (play_counts, _q("select album_id, cast(sum(n) as bigint) as play_count, max(seen) as played_at from (select id as album_id, id as n, cast(null as timestamp) as seen from album union all select album_id, 1, played_at from play) group by 1")),
        "players": (players, "select count(*) as n, count(*) as ids, 0 as least, 24 + count(*) filter (k = 1) as most from (select n_name as name, 0 as k from nation union all select distinct s_name, 1 from supplier)"),
        "insert_new": (first_kept, "select user_id, case when user_id % 2 = 0 then max(event_id) else min(event_id) end as event_id, case when user_id % 2 = 0 then max_by(event_type, event_id) else min_by(event_type, event_id) end as event_type from events group by 1"),
        "replaced_lists": (exchanged_lists, "select conv_id, turn, case when conv_id in (select conv_id from conversations where turn = 0 and conv_id % 3 = 0) then 'only' else role end as role from conversations where turn = 0 or conv_id not in (select conv_id from conversations where turn = 0 and conv_id % 3 = 0)"),
        "swept_trees": (swept, _q("select root_id, rel_path, id from album a where id % 2 = 1 or exists (select 1 from release r where r.year < 2000 and r.root_id = a.root_id and (a.rel_path = r.rel_path or starts_with(a.rel_path, r.rel_path || '/')))")),
        "removed_roots": (removed_roots, _q("select a.root_id, count(*) as songs from track t join album a on a.id = t.album_id where a.root_id <> 2 group by 1")),
        "export_restore": (exported, "select case when turn < 3 then 'placed' else 'skipped' end as state, role, count(*) as n from conversations group by 1, 2"),
        "stats": (stats, _q("select 'album' as name, count(*) as n from album union all select 'artist', count(*) from artist union all select 'file', count(*) from file union all select 'play', count(*) from play union all select 'release', count(*) from release union all select 'root', count(*) from root union all select 'track', count(*) from track")),
        "event_kinds": (event_kinds, "select coalesce(event_type, 'none') as kind, count(*) as n from events group by 1 order by n desc, kind limit 3"),
        "asked_in_order": (asked_in_order, _q("select x.place, s.id, s.title, s.year from (select -id as place, id from album where id % 97 = 1 and release_id is null union all select id, id from album where id % 97 = 1 and id % 2 = 0 and release_id is null) x join album_select s on s.id = x.id")),
        "files_with_genre": (with_genre, _q("select id, exists (select 1 from file_tag t where t.file_id = f.id and t.name = 'genre' and trim(t.value) <> '') as has_genre from file f")),
        "files_at": (files_at, _q("select r.id as release_id, count(*) as files, min(f.id) as first from release r join file f on r.rel_path = 'c' || (f.id % 50) or r.rel_path = 'c' || (f.id % 40) group by 1")),
        "common_artists": (album_artists, _q("select release_id, min(x) as artist, count(*) as common from (select release_id, artist_id as x, id from album where release_id is not null and artist_id is not null union select release_id, cast(artist_id + id % 2 as int), id from album where release_id is not null and artist_id is not null) s where not exists (select 1 from album b where b.release_id = s.release_id and b.artist_id is not null and s.x <> b.artist_id and s.x <> b.artist_id + b.id % 2) group by release_id, x").replace("select release_id, min(x) as artist, count(*) as common from", "select release_id, min(x) as artist, count(*) as common from (select release_id, x from") + ") group by 1"),
        "homonyms": (homonyms, _q("select id, artist_id || '-' || year || case when k > 1 then '#' || k else '' end as key from (select *, row_number() over (partition by artist_id, year order by root_id, rel_path) as k from release)")),
        "covers": (covers, _q("select folder, name from (select *, row_number() over (partition by folder order by case when id % 6 < 4 then id % 6 else 9 end, folder_rel_path || '/' || name, id) as k from (select id, folder_rel_path, folder_rel_path || '/' || id % 50 as folder, case id % 6 when 0 then 'Front scan' when 1 then 'cover-2' when 2 then 'folder' when 3 then 'ALBUM art' when 4 then 'back cover' else 'discovery' end || ' ' || id || '.jpg' as name from file)) where k = 1")),
        "natural_order": (naturally_ordered, _q("select id, row_number() over (partition by artist_id order by cast(substr(rel_path, 2) as bigint), id) as place from release")),
        "listing_order": (listed, _q("select id, year, title from album_select order by year is null, year, title, rel_path, id limit 200")),
        "earliest": (earliest, _q("select artist_id, year, arm, id from (select *, row_number() over (partition by artist_id order by year, arm, id) as k from (select artist_id, year, 0 as arm, id from release union all select artist_id, year, 1, id from album where artist_id is not null)) where k = 1")),
        "first_dated": (first_dated, _q("select a.id, coalesce(s.said, a.year) as year from album a left join (select album_id, said from (select t.album_id, cast(900 + t.file_id % 400 as int) as said, row_number() over (partition by t.album_id order by f.rel_path, t.file_id) as k from track t join file f on f.id = t.file_id where 900 + t.file_id % 400 >= 1000) where k = 1) s on s.album_id = a.id")),
        "matched_files": (matched_cues, _q("select id, file_id, score from (select a.id, f.id as file_id, case when a.id % 3 = 0 and f.id % 2 = 1 then 3 else 2 end as score, row_number() over (partition by a.id order by case when a.id % 3 = 0 and f.id % 2 = 1 then 0 else 1 end, f.rel_path, f.id) as k from album a join file f on f.root_id = a.id % 5 and f.id % 9 = a.id % 7) where k = 1")),
    }
