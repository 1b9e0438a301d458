"""State, paths, search, lists and text fields of the catalogue, each with its counterpart in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import expressions as X
from shelfmark.operators import keyed, paths, search
from shelfmark.plans.views import Views
from shelfmark.sources.tables import TABLES_SQL


def records_under(v: Views) -> DataFrame:
    return paths.counts_under(v.album.select("root_id", "rel_path"), v.release.select("root_id", F.col("rel_path").alias("folder")), ["root_id"])


def owning_folder(v: Views) -> DataFrame:
    return paths.owner(v.album.select("root_id", "rel_path"), v.release.select("root_id", F.col("rel_path").alias("folder")), ["root_id"])


def snapshot(v: Views) -> DataFrame:
    """Orders against a copy in which some are gone, some dearer and some new."""
    before = v.read("orders").select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    after = before.filter(key % 13 != 0).select(
        F.when(key % 17 == 0, -key - 1).otherwise(key).alias("o_orderkey"), F.when(key % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice")
    )
    return keyed.compare(before, after, ["o_orderkey"], ["o_totalprice"])


def year_kept(v: Views) -> DataFrame:
    """Release years after an upsert in which unknown years leave the old ones alone."""
    old = v.release.select("id", "year", "title")
    new = v.release.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("year") + 1).alias("year"), F.concat("title", F.lit("!")).alias("title"))
    return keyed.upsert(old, new, ["id"], keep_known=("year",))


def now_playing(v: Views) -> DataFrame:
    return keyed.last_of_each(v.read("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "event_id")


def play_rollup(v: Views) -> DataFrame:
    return v.play.groupBy("album_id").agg(F.count("*").alias("play_count"), F.max("played_at").alias("played_at"))


def playlists(v: Views) -> DataFrame:
    """Each list's length, what it starts with and its items in order."""
    c = v.read("conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("role", "turn").alias("first_role"), F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"), F.sum(F.length("text")).alias("chars"))


def edited_playlists(v: Views) -> DataFrame:
    c = v.read("conversations").select("conv_id", F.col("turn").alias("position"), "role")
    first = c.filter("position = 0").withColumn("role", F.lit("added"))
    return keyed.removed_and_appended(c, "conv_id", [0, 2], first)


def found(v: Views) -> DataFrame:
    return search.matching(v.read("documents"), "text", ["the", "st"]).select("doc_id", "lang")


def ranked(v: Views) -> DataFrame:
    return search.hits(v.read("documents"), "doc_id", "text", ["the", "and"])


def orphans(v: Views) -> DataFrame:
    """Artists that no record and no release names; and, to have some, countries' suppliers count as artists, too."""
    every = v.artist.select("id", "name").union(v.read("supplier").select((F.col("s_suppkey") + 10).cast("int"), "s_name"))
    return unused(every, v.album.select("artist_id"), v.release.select("artist_id"))


def unused(artists: DataFrame, *references: DataFrame) -> DataFrame:
    """``artists`` (id) that none of ``references`` (artist_id) names; each name counts once before it is sent anywhere."""
    for used in references:
        used = used.filter("artist_id IS NOT NULL").distinct()
        artists = artists.join(used, F.col("id") == F.col("artist_id"), "left_anti")
    return artists


def unplayed(v: Views) -> DataFrame:
    """Albums with neither a song nor a play."""
    return v.album.join(v.track.select("album_id"), F.col("id") == F.col("album_id"), "left_anti").join(v.play.select(F.col("album_id").alias("p")), F.col("id") == F.col("p"), "left_anti").select("id", "rel_path")


def collisions(v: Views) -> DataFrame:
    """Albums of one artist, title and year, numbered by path where there are several."""
    same = ["artist_id", "title", "year"]
    named = v.album.filter("artist_id IS NOT NULL").select("id", "root_id", "rel_path", *same)
    per_root = named.groupBy(*same, "root_id").agg(F.count("*").alias("n"))  # counted before rows meet; numbers go by root, then within it
    roots = Window.partitionBy(*same).orderBy("root_id")
    sizes = per_root.withColumn("before", F.sum("n").over(roots) - F.col("n")).withColumn("copies", F.sum("n").over(Window.partitionBy(*same))).filter("copies >= 2").drop("n")
    place = F.row_number().over(Window.partitionBy(*same, "root_id").orderBy("rel_path"))
    return named.join(sizes, [*same, "root_id"]).select("id", "copies", (F.col("before") + place).alias("place"))


def segments(v: Views) -> DataFrame:
    """Where each song of an album begins and ends when they lie end to end."""
    w = Window.partitionBy("album_id").orderBy("ordinal")
    starts = F.coalesce(F.sum("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return v.track.select("id", "album_id", "ordinal", "duration_ms", starts.alias("start_ms")).withColumn("end_ms", F.lead("start_ms").over(w)).select("id", "start_ms", F.coalesce("end_ms", F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), X.clock("start_ms").alias("shown"))


def path_fields(v: Views) -> DataFrame:
    u = F.col("url")
    return v.read("pages").select("page_id", X.basename(u).alias("base"), X.folder_of(u).alias("folder"), X.stem(u).alias("stem"), X.nocase_key(u).alias("key"))


def event_fields(v: Views) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return v.read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def junk_ratio(v: Views) -> DataFrame:
    """Nations' customers by segment, and whether strangers outweigh the rest by more than ten to one."""
    strangers, songs = F.sum(F.when(F.col("c_mktsegment") != "BUILDING", 1).otherwise(0)), F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0))
    return v.read("customer").groupBy("c_nationkey").agg(strangers.alias("strangers"), songs.alias("songs"), F.when((strangers >= 5) & (strangers > 10 * songs), "rule").alias("reason"))


def display_names(v: Views) -> DataFrame:
    """The most frequent segment of each nation's customers; the shorter, then the smaller, on a tie."""
    n = v.read("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.groupBy("c_nationkey").agg(F.min(F.struct(-F.col("n"), F.length("c_mktsegment"), "c_mktsegment"))["c_mktsegment"].alias("name"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(text: str) -> str:
    return TABLES_SQL + text


def queries() -> dict:
    base = "regexp_extract(url, '([^/]*)$', 1)"
    return {
        "records_under_counts": (records_under, _q("select r.root_id, r.rel_path as folder, count(a.id) as n from release r left join album a on a.root_id = r.root_id and (a.rel_path = r.rel_path or starts_with(a.rel_path, r.rel_path || '/')) group by 1, 2")),
        "owning_folder": (owning_folder, _q("select root_id, rel_path, max_by(f, length(f)) as owner from (select a.root_id, a.rel_path, r.rel_path as f from album a join release r on a.root_id = r.root_id and starts_with(a.rel_path, r.rel_path || '/')) group by 1, 2")),
        "snapshot_compare": (snapshot, "with b as (select o_orderkey, o_totalprice from orders), a as (select case when o_orderkey % 17 = 0 then -o_orderkey - 1 else o_orderkey end as o_orderkey, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 13 <> 0) select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'vanished' when a.o_totalprice is not distinct from b.o_totalprice then 'same' else 'changed' end as state from b full join a on a.o_orderkey = b.o_orderkey"),
        "upsert_keep_known": (year_kept, _q("select id, case when id % 3 = 0 and id % 2 = 0 then year + 1 else year end as year, case when id % 3 = 0 then title || '!' else title end as title from release")),
        "now_playing": (now_playing, "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type, max_by(ts, event_id) as ts from events group by 1"),
        "play_rollup": (play_rollup, _q("select album_id, count(*) as play_count, max(played_at) as played_at from play group by 1")),
        "playlists": (playlists, "select conv_id, count(*) as n, min_by(role, turn) as first_role, string_agg(role, ',' order by turn) as roles, cast(sum(length(text)) as bigint) as chars from conversations group by 1"),
        "edited_playlists": (edited_playlists, "select conv_id, row_number() over (partition by conv_id order by part, turn) - 1 as position, role from (select conv_id, turn, role, 0 as part from conversations where turn not in (0, 2) union all select conv_id, turn, 'added', 1 from conversations where turn = 0)"),
        "search_documents": (found, r"select doc_id, lang from documents where regexp_matches(lower(text), '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])') and regexp_matches(lower(text), '(^|[^\p{L}\p{N}])st')"),
        "search_ranked": (ranked, r"with w as (select doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) as word from documents) select doc_id, count(*) as hits from w where word = 'the' or starts_with(word, 'and') group by 1 having bool_or(word = 'the') and bool_or(starts_with(word, 'and'))"),
        "orphan_artists": (orphans, _q("select id, name from (select id, name from artist union all select s_suppkey + 10, s_name from supplier) where id not in (select artist_id from album where artist_id is not null union select artist_id from release)")),
        "albums_without_songs": (unplayed, _q("select id, rel_path from album a where not exists (select 1 from track t where t.album_id = a.id) and not exists (select 1 from play p where p.album_id = a.id)")),
        "collisions": (collisions, _q("select * from (select id, count(*) over (partition by artist_id, title, year) as copies, row_number() over (partition by artist_id, title, year order by root_id, rel_path) as place from album where artist_id is not null) where copies >= 2")),
        "segments": (segments, _q("select id, start_ms, start_ms + duration_ms as end_ms, case when s // 3600 > 0 then (s // 3600) || ':' || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') else (s // 60) || ':' || lpad(cast(s % 60 as varchar), 2, '0') end as shown from (select *, cast(floor(start_ms / 1000.0 + 0.5) as bigint) as s from (select id, duration_ms, cast(coalesce(sum(duration_ms) over (partition by album_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms from track))")),
        "path_fields": (path_fields, f"select page_id, {base} as base, case when contains(url, '/') then regexp_extract(url, '^(.*)/[^/]*$', 1) else '' end as folder, regexp_replace({base}, '^(.+)\\.[^.]*$', '\\1') as stem, {_FOLD.format('url')} as key from pages"),
        "event_fields": (event_fields, "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as sum_k, count(distinct user_id) as users, min(ts) as first, max(ts) as last from events group by 1"),
        "junk_ratio": (junk_ratio, "select c_nationkey, strangers, songs, case when strangers >= 5 and strangers > 10 * songs then 'rule' end as reason from (select c_nationkey, count(*) filter (c_mktsegment <> 'BUILDING') as strangers, count(*) filter (c_mktsegment = 'BUILDING') as songs from customer group by 1)"),
        "display_names": (display_names, "select c_nationkey, c_mktsegment as name from (select *, row_number() over (partition by c_nationkey order by n desc, length(c_mktsegment), c_mktsegment) as k from (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2)) where k = 1"),
    }
