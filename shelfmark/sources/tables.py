"""Reading the source tables, and the catalogue's logical tables bound to them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that count as padding in tag values: space, tab, line feed, carriage return, no-break and ideographic space.
BLANKS = " \t\n\r 　"


def trimmed(c) -> F.Column:
    return F.btrim(c if isinstance(c, F.Column) else F.col(c), F.lit(BLANKS))


class Tables:
    """The logical tables over one folder of Parquet tables; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def root(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("/"), "r_name").alias("path"))

    @cached_property
    def artist(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("name_key"))

    @cached_property
    def release(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("id"), (key % 5).alias("root_id"), F.concat(F.lit("c"), key.cast("string")).alias("rel_path"), F.col("c_name").alias("title"),
            F.col("c_nationkey").alias("artist_id"), (F.lit(1990) + key % 30).cast("int").alias("year"),
        )

    @cached_property
    def album(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        boxed = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        return self.read("orders").select(
            o.alias("id"), (c % 5).alias("root_id"), F.concat(F.lit("c"), c.cast("string"), F.lit("/o"), o.cast("string")).alias("rel_path"),
            F.col("o_orderpriority").alias("title"), F.when(o % 7 != 0, (c % 25).cast("int")).alias("artist_id"), F.when(boxed, c).alias("release_id"),
            F.when(boxed & (o % 3 != 0), o % 9).alias("disc_number"), F.year("o_orderdate").cast("int").alias("year"),
            F.when((F.col("o_orderstatus") == "P") & (o % 5 == 0), F.lit("rule")).alias("junk_reason"),
        )

    @cached_property
    def track(self) -> DataFrame:
        return self.tracks()

    def tracks(self, albums: DataFrame | None = None, pieces: int | None = None) -> DataFrame:
        """One row for each (album, ordinal), which is what identifies a track; of ``albums`` (id) alone, if given, before anything is grouped.

        ``pieces``: so many that Spark does not put together to larger ones, for what holds many rows of each track in memory.
        """
        rows = self.read("lineitem")
        rows = rows if albums is None else rows.join(albums.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
        rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition(*([pieces] if pieces else []), "l_orderkey")  # what goes by album next need not move again
        return (
            rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("file_id"), (F.max("l_quantity").cast("bigint") * 1000).alias("duration_ms"))
            .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("album_id"), F.col("l_linenumber").alias("ordinal"), "file_id", "duration_ms")
        )

    @cached_property
    def file(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.read("part").select(p.alias("id"), (p % 5).alias("root_id"), F.concat("p_type", F.lit("/"), "p_name", F.lit("-"), p.cast("string")).alias("rel_path"), F.col("p_type").alias("folder_rel_path"))

    @cached_property
    def file_tag(self) -> DataFrame:
        """(file_id, name, value, position), any name and several values a name; made in one pass over the files."""
        p = F.col("p_partkey")
        tag = lambda name, value, position, when: F.when(when, F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(position).alias("position")))
        tags = F.array(
            tag("genre", F.lit("  "), 0, p % 4 == 0), tag("genre", F.concat(F.lit(" "), "p_type", F.lit(" ")), 1, p % 11 != 0),
            tag("genre", F.col("p_name"), 2, p % 3 == 0), tag("artist", F.col("p_brand"), 0, F.lit(True)),
        )
        return self.read("part").select(p.alias("file_id"), F.inline(F.array_compact(tags)))

    @cached_property
    def play(self) -> DataFrame:
        e = self.read("events").filter(F.col("event_type").isin("view", "purchase"))
        return e.select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 4).cast("bigint").alias("album_id"), F.col("ts").alias("played_at"), F.col("user_id").alias("player_id"))


#: The same logical tables in DuckDB's SQL, as the head of every query's counterpart.
TABLES_SQL = """
with root as (select r_regionkey as id, concat('/', r_name) as path from region),
artist as (select n_nationkey as id, n_name as name, lower(n_name) as name_key from nation),
release as (select c_custkey as id, c_custkey % 5 as root_id, concat('c', c_custkey) as rel_path, c_name as title, c_nationkey as artist_id,
  cast(1990 + c_custkey % 30 as int) as year from customer),
album as (select o_orderkey as id, o_custkey % 5 as root_id, concat('c', o_custkey, '/o', o_orderkey) as rel_path, o_orderpriority as title,
  case when o_orderkey % 7 = 0 then null else cast(o_custkey % 25 as int) end as artist_id,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_custkey end as release_id,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey % 3 <> 0 then o_orderkey % 9 end as disc_number,
  cast(year(o_orderdate) as int) as year, case when o_orderstatus = 'P' and o_orderkey % 5 = 0 then 'rule' end as junk_reason from orders),
track as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as album_id, l_linenumber as ordinal, max(l_partkey) as file_id,
  cast(max(l_quantity) as bigint) * 1000 as duration_ms from lineitem group by l_orderkey, l_linenumber),
file as (select p_partkey as id, p_partkey % 5 as root_id, concat(p_type, '/', p_name, '-', p_partkey) as rel_path, p_type as folder_rel_path from part),
file_tag as (select p_partkey as file_id, 'genre' as name, '  ' as value, 0 as position from part where p_partkey % 4 = 0
  union all select p_partkey, 'genre', concat(' ', p_type, ' '), 1 from part where p_partkey % 11 <> 0
  union all select p_partkey, 'genre', p_name, 2 from part where p_partkey % 3 = 0
  union all select p_partkey, 'artist', p_brand, 0 from part),
play as (select event_id as id, cast(floor(event_id / 4) as bigint) as album_id, ts as played_at, user_id as player_id from events where event_type in ('view', 'purchase')),
grouped as (select *, case when release_id is null then concat('a', id) else concat('r', release_id) end as group_id from album),
grp as (select *, first_value(id) over w as rep_id, row_number() over w as rn from grouped
  window w as (partition by group_id order by disc_number is null, disc_number nulls first, rel_path, id)),
totals as (select group_id, count(*) as song_count, cast(sum(duration_ms) as bigint) as duration_ms from grp join track on track.album_id = grp.id group by group_id),
genre_rows as (select g.group_id, trim(ft.value, concat(' ', chr(9), chr(10), chr(13), chr(160), chr(12288))) as value, f.rel_path, ft.position, f.id as file_id
  from grp g join track t on t.album_id = g.id join file f on f.id = t.file_id join file_tag ft on ft.file_id = f.id and ft.name = 'genre'),
genre1 as (select group_id, value from (select *, row_number() over (partition by group_id order by rel_path, position, file_id) as k from genre_rows where value <> '') where k = 1),
album_select as (
  select g.id, g.group_id, coalesce(r.root_id, g.root_id) as root_id, coalesce(r.rel_path, g.rel_path) as rel_path, coalesce(r.title, g.title) as title,
    coalesce(r.artist_id, g.artist_id) as artist_id, a.name as artist_name, coalesce(r.year, g.year) as year, coalesce(t.song_count, 0) as song_count,
    coalesce(t.duration_ms, 0) as duration_ms, x.value as genre, g.junk_reason
  from grp g left join release r on r.id = g.release_id left join artist a on a.id = coalesce(r.artist_id, g.artist_id)
  left join totals t on t.group_id = g.group_id left join genre1 x on x.group_id = g.group_id where g.rn = 1),
song_select as (
  select t.id, t.album_id, t.ordinal, t.duration_ms, f.rel_path, ro.path as root_path, g.rep_id, coalesce(r.title, g.title) as album_title,
    coalesce(r.artist_id, g.artist_id) as artist_id, coalesce(a1.name, a2.name) as artist_name, coalesce(r.year, g.year) as year, first_genre.value as genre, g.junk_reason
  from track t join file f on f.id = t.file_id join root ro on ro.id = f.root_id left join grp g on g.id = t.album_id left join release r on r.id = g.release_id
  left join artist a1 on a1.id = g.artist_id left join artist a2 on a2.id = r.artist_id
  left join (select file_id, value from (select file_id, trim(value, concat(' ', chr(9), chr(10), chr(13), chr(160), chr(12288))) as value,
    row_number() over (partition by file_id order by position) as k from file_tag
    where name = 'genre' and trim(value, concat(' ', chr(9), chr(10), chr(13), chr(160), chr(12288))) <> '') where k = 1) first_genre on first_genre.file_id = t.file_id)
"""
