"""Listings of records, songs, artists and genres, each with its counterpart in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.expressions import index_letter, sort_key
from shelfmark.plans.views import Views
from shelfmark.sources.tables import TABLES_SQL, trimmed

MOST, USUAL = 500, 10


def page(df: DataFrame, *order, size: int = USUAL, offset: int = 0) -> DataFrame:
    """A page: 1 to ``MOST`` rows from ``offset`` on, in an order that ends in a unique key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, size), MOST))


def visible(df: DataFrame, hidden: bool = False) -> DataFrame:
    """Listings leave junk out; reads by id do not."""
    return df if hidden else df.filter("junk_reason IS NULL")


def plays(v: Views) -> DataFrame:
    """Plays and the last of them by record."""
    seen = v.play.groupBy("album_id").agg(F.count("*").alias("n"), F.max("played_at").alias("last"))
    by_group = seen.join(v.grouped.select(F.col("id").alias("album_id"), F.col("group_id").alias("g")), "album_id")
    return by_group.groupBy("g").agg(F.sum("n").alias("play_count"), F.max("last").alias("last_played"))


def drawn(seed: int) -> F.Column:
    """An order that a seed and the id decide alone, so that a draw can be told again."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))


#: Stars and ratings of records: every eleventh and seventh customer's, as the fixture has them.
def annotated(v: Views) -> DataFrame:
    return v.records.withColumn("starred", F.when(F.col("id") % 11 == 0, F.col("id") % 1000)).withColumn("rating", F.when(F.col("id") % 7 == 1, F.col("id") % 5 + 1))


def album_list(v: Views, kind: str, size: int = 50, offset: int = 0, seed: int = 0) -> DataFrame:
    """Records in one of eight orders: the page is found first, from what records say of themselves, and then told."""
    df = visible(v.records)
    if kind in ("frequent", "recent"):
        df = df.join(plays(v), F.col("group_id") == F.col("g"))
        first = F.desc("play_count" if kind == "frequent" else "last_played")
        return v.of_page(page(df, first, "id", size=size, offset=offset)).select("id", "title", "artist_name", "year", "song_count", "duration_ms", "genre", "play_count", "last_played")
    if kind in ("starred", "highest"):
        column = {"starred": "starred", "highest": "rating"}[kind]
        df = visible(annotated(v)).filter(F.col(column).isNotNull())
        return page(df, F.desc(column), "id", size=size, offset=offset).select("id", "title", "artist_name", "year", column)
    order = {
        "newest": (F.desc("id"),), "random": (drawn(seed), "id"), "alphabetical_name": ("title", "id"),
        "alphabetical_artist": (F.asc_nulls_first("artist_name"), F.asc_nulls_first("year"), "title", "id"),
    }[kind]
    return v.of_page(page(df, *order, size=size, offset=offset)).select("id", "title", "artist_name", "year", "song_count", "duration_ms", "genre")


def by_year(v: Views, first: int, last: int, size: int = 100) -> DataFrame:
    return v.of_page(page(visible(v.records).filter(F.col("year").between(first, last)), "year", "title", "id", size=size)).select("id", "title", "year", "song_count")


def by_genre(v: Views, genre: str, size: int = 100) -> DataFrame:
    """Records with at least one song of the genre."""
    files = v.genre_values.filter(F.col("value") == genre).select("file_id").distinct()
    groups = v.track.join(files, "file_id", "left_semi").select("album_id").distinct().join(v.grouped.select(F.col("id").alias("album_id"), F.col("group_id").alias("g")), "album_id")
    return v.of_page(page(visible(v.records).join(groups, F.col("group_id") == F.col("g"), "left_semi"), "title", "id", size=size)).select("id", "title", "genre")


def genres(v: Views) -> DataFrame:
    """Songs and records of each genre. Both are counted in one aggregate, which holds each song and record of a piece: pieces stay as small as they are dealt."""
    songs = v.tracks(pieces=int(v.spark.conf.get("spark.sql.shuffle.partitions"))).join(v.grouped.select(F.col("id").alias("album_id"), "group_id", "junk_reason"), "album_id").filter("junk_reason IS NULL")
    return songs.join(v.genre_values, "file_id").groupBy("value").agg(F.countDistinct("id").alias("song_count"), F.countDistinct("group_id").alias("album_count"))


def songs_of_album(v: Views, ids: list[int]) -> DataFrame:
    """All songs of the records that the albums belong to, disc after disc."""
    groups = v.grouped.filter(F.col("id").isin(ids)).select("group_id").distinct()
    discs = v.grp.join(groups, "group_id", "left_semi").select(F.col("id").alias("album_id"), "rn")
    return v.songs(v.tracks(discs.select(F.col("album_id").alias("id")))).join(discs, "album_id").select("id", "album_id", "rn", "ordinal", "duration_ms", "rel_path", "album_title", "artist_name")


def songs_by_genre(v: Views, genre: str, size: int = 200, offset: int = 20) -> DataFrame:
    files = v.genre_values.filter(F.col("value") == genre).select("file_id").distinct()
    songs = visible(v.songs(v.track.join(files, "file_id", "left_semi")))
    return page(songs, "rel_path", "id", size=size, offset=offset).select("id", "rel_path", "album_title")


def random_songs(v: Views, size: int = 50, seed: int = 1, genre: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """A draw of songs after all filters; the same seed draws alike."""
    df = visible(v.song_select)
    if genre is not None:
        df = df.filter(F.col("genre") == genre)
    if years is not None:
        df = df.filter(F.col("year").between(*years))
    return page(df, drawn(seed), "id", size=size)


def artists(v: Views) -> DataFrame:
    """Artists with records of their own, with their number."""
    n = visible(v.records).groupBy("artist_id").agg(F.count("*").alias("album_count"))
    return v.artist.join(n, F.col("id") == F.col("artist_id")).select("id", "name", "album_count", index_letter(sort_key("name")).alias("letter"))


def artist_counts(v: Views, ids: list[int]) -> DataFrame:
    """The asked artists, with as many records as their representatives name; zero where none."""
    own = v.grp.filter("rn = 1 AND junk_reason IS NULL").select("artist_id", F.col("id").alias("album"))
    return v.artist.filter(F.col("id").isin(ids)).join(own, F.col("id") == F.col("artist_id"), "left").groupBy("id", "name").agg(F.count("album").alias("album_count"))


def artist_roles(v: Views) -> DataFrame:
    """What each artist is known as, sorted."""
    sung = v.track.join(v.file.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("album_id").alias("id"))
    said = v.release.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("group_id"), F.col("artist_id").alias("said"))  # by group: many albums have no release
    with_songs = v.grouped.join(sung, "id", "left_semi").join(said, "group_id", "left").select(F.coalesce("said", "artist_id").alias("artist_id"))
    arms = [
        v.album.filter("artist_id IS NOT NULL").select("artist_id", F.lit("albumartist").alias("role")), v.release.select("artist_id", F.lit("albumartist").alias("role")),
        with_songs.filter("artist_id IS NOT NULL").select("artist_id", F.lit("artist").alias("role")),
        v.album.filter("artist_id IS NOT NULL AND disc_number IS NOT NULL").select("artist_id", F.lit("boxartist").alias("role")),
    ]
    every = arms[0].union(arms[1]).union(arms[2]).union(arms[3])
    return every.groupBy("artist_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def index_letters(v: Views) -> DataFrame:
    """Artists by the letter they are filed under."""
    named = v.artist.select("id", "name", index_letter(sort_key("name")).alias("letter"))
    return named.groupBy("letter").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "id"))), lambda x: x["name"]), "|").alias("names"))


def first_genre(v: Views) -> DataFrame:
    return v.genre1(v.grouped, v.track).select("group_id", "value")


def representatives(v: Views) -> DataFrame:
    return v.grp.select("id", "group_id", "rep_id", "rn")


def first_values(tags: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The first value of each tag that is not blank, of ``tags`` (file_id, name, position, value): a column for each name of ``columns``."""
    said = tags.select("file_id", "name", "position", trimmed("value").alias("value")).filter((F.col("value") != "") & F.col("name").isin(*columns))
    picked = [F.min(F.when(F.col("name") == n, F.struct("position", "value")))["value"].alias(c) for n, c in columns.items()]
    return said.groupBy("file_id").agg(*picked)


def first_tags(v: Views, names: tuple[str, ...] = ("artist", "genre")) -> DataFrame:
    return first_values(v.file_tag, {n: f"first_{n}" for n in names})


_PAGE = "order by {} limit {}"
_FIELDS = "id, title, artist_name, year, song_count, duration_ms, genre"
_PLAYS = ", pl as (select g.group_id as g, count(*) as play_count, max(played_at) as last_played from play p join grp g on g.id = p.album_id group by 1)"
_SEEN = "select id, title, artist_name, year, song_count, duration_ms, genre, play_count, last_played from album_select join pl on group_id = g where junk_reason is null"
_BLANK = "concat(' ', chr(9), chr(10), chr(13), chr(160), chr(12288))"


def _q(text: str) -> str:
    return TABLES_SQL + text


def queries() -> dict:
    g = "ECONOMY"
    return {
        "album_select": (lambda v: v.album_select, _q("select * from album_select")),
        "album_list_frequent": (lambda v: album_list(v, "frequent"), _q(_PLAYS + _SEEN + " order by play_count desc, id limit 50")),
        "album_list_recent": (lambda v: album_list(v, "recent"), _q(_PLAYS + _SEEN + " order by last_played desc, id limit 50")),
        "album_list_newest": (lambda v: album_list(v, "newest", 20, 5), _q(f"select {_FIELDS} from album_select where junk_reason is null order by id desc limit 20 offset 5")),
        "album_list_alphabetical_name": (lambda v: album_list(v, "alphabetical_name", 500), _q(f"select {_FIELDS} from album_select where junk_reason is null order by title, id limit 500")),
        "album_list_alphabetical_artist": (lambda v: album_list(v, "alphabetical_artist", 500), _q(f"select {_FIELDS} from album_select where junk_reason is null order by artist_name nulls first, year nulls first, title, id limit 500")),
        "album_list_starred": (lambda v: album_list(v, "starred"), _q("select id, title, artist_name, year, case when id % 11 = 0 then id % 1000 end as starred from album_select where junk_reason is null and id % 11 = 0 order by starred desc, id limit 50")),
        "album_list_highest": (lambda v: album_list(v, "highest"), _q("select id, title, artist_name, year, case when id % 7 = 1 then id % 5 + 1 end as rating from album_select where junk_reason is null and id % 7 = 1 order by rating desc, id limit 50")),
        "album_list_random": (lambda v: album_list(v, "random"), _q(f"select {_FIELDS} from album_select where junk_reason is null order by md5('0:' || id), id limit 50")),
        "album_list_by_year": (lambda v: by_year(v, 1992, 1998), _q("select id, title, year, song_count from album_select where junk_reason is null and year between 1992 and 1998 order by year, title, id limit 100")),
        "album_list_by_year_reversed": (lambda v: by_year(v, 1998, 1992), _q("select id, title, year, song_count from album_select where junk_reason is null and year between 1998 and 1992 order by year, title, id limit 100")),
        "album_list_by_genre": (lambda v: by_genre(v, g), _q(f"select id, title, genre from album_select where junk_reason is null and group_id in (select group_id from genre_rows where value = '{g}') order by title, id limit 100")),
        "genres": (genres, _q("select trim(ft.value, " + _BLANK + ") as value, count(distinct t.id) as song_count, count(distinct g.group_id) as album_count from file_tag ft join track t on t.file_id = ft.file_id join grp g on g.id = t.album_id where ft.name = 'genre' and g.junk_reason is null and trim(ft.value, " + _BLANK + ") <> '' group by 1")),
        "song_select": (lambda v: v.song_select, _q("select * from song_select")),
        "songs_of_album": (lambda v: songs_of_album(v, [3, 17, 44]), _q("select s.id, s.album_id, g.rn, s.ordinal, s.duration_ms, s.rel_path, s.album_title, s.artist_name from song_select s join grp g on g.id = s.album_id where g.group_id in (select group_id from grp where id in (3, 17, 44))")),
        "songs_by_genre": (lambda v: songs_by_genre(v, g), _q(f"select id, rel_path, album_title from song_select where junk_reason is null and id in (select t.id from track t join file_tag f on f.file_id = t.file_id where f.name = 'genre' and trim(f.value, {_BLANK}) = '{g}') order by rel_path, id limit 200 offset 20")),
        "random_songs": (lambda v: random_songs(v, 50, 1, None, (1992, 1998)), _q("select * from song_select where junk_reason is null and year between 1992 and 1998 order by md5('1:' || id), id limit 50")),
        "artists_with_counts": (artists, _q("select a.id, a.name, count(*) as album_count, case when regexp_matches(upper(substr(a.name, 1, 1)), '^[\\p{L}\\p{N}]$') then upper(substr(a.name, 1, 1)) else '#' end as letter from artist a join album_select s on s.artist_id = a.id where s.junk_reason is null group by 1, 2, 4")),
        "artist_counts": (lambda v: artist_counts(v, [1, 5, 24, 99]), _q("select a.id, a.name, count(g.id) as album_count from artist a left join grp g on g.artist_id = a.id and g.rn = 1 and g.junk_reason is null where a.id in (1, 5, 24, 99) group by 1, 2")),
        "artist_roles": (artist_roles, _q("select artist_id, string_agg(role, ',' order by role) as roles from (select artist_id, 'albumartist' as role from album where artist_id is not null union select artist_id, 'albumartist' from release union select artist_id, 'artist' from song_select where artist_id is not null union select artist_id, 'boxartist' from album where artist_id is not null and disc_number is not null) group by 1")),
        "index_letters": (index_letters, _q("select upper(substr(name, 1, 1)) as letter, count(*) as n, string_agg(name, '|' order by name, id) as names from artist group by 1")),
        "group_representatives": (representatives, _q("select id, group_id, rep_id, rn from grp")),
        "first_genre_per_group": (first_genre, _q("select group_id, value from genre1")),
        "first_tag_pivot": (first_tags, _q(f"select file_id, max(case when name = 'artist' then value end) as first_artist, max(case when name = 'genre' then value end) as first_genre from (select file_id, name, value, row_number() over (partition by file_id, name order by position) as k from (select file_id, name, position, trim(value, {_BLANK}) as value from file_tag) where value <> '') where k = 1 group by 1")),
    }
