"""What streams keep and decide, and what changed between scans, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import changes
from shelfmark.plans.views import Views
from shelfmark.sources.kept import shared_folder
from shelfmark.sources.tables import TABLES_SQL
from shelfmark.streaming import plays, requests, state


def _stream(v: Views, table: str) -> DataFrame:
    """A table as a stream of its files. A pattern is read in the same way whether a table is a file or a folder."""
    return v.spark.readStream.schema(v.read(table).schema).parquet(f"{v.folder}/{table}.parque[t]")


def _timed(v: Views) -> DataFrame:
    return _stream(v, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _place(v: Views, name: str) -> str:
    return f"{shared_folder(v.spark)}/shelfmark/{name}-{uuid.uuid4().hex}"


def streamed_now_playing(v: Views) -> DataFrame:
    """What each user did last, kept by a stream over all events."""
    query, kept = state.latest(_stream(v, "events").select("user_id", "event_id", "event_type", "ts"), _place(v, "playing"), ["user_id"], ["event_id"], 8)
    query.awaitTermination()
    return kept.read()


def _written(stream: DataFrame, path: str) -> DataFrame:
    """A stream's rows, each batch in a folder of its own, so that one written twice counts once."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def decided_requests(v: Views) -> DataFrame:
    """Events as requests: the user in twenties is the key, every seventh user sends none."""
    u = F.col("user_id")
    asked = _timed(v).select(F.col("event_id").alias("id"), F.when(u % 7 != 0, F.concat(F.lit("k"), (u % 20).cast("string"))).alias("key"), F.col("event_type").alias("method"), (F.col("event_id") % 2).cast("string").alias("path"), F.col("ts").alias("at"))
    return _written(requests.decided(asked), _place(v, "requests")).select("id", "outcome", "answered_by")


def hourly_plays(v: Views) -> DataFrame:
    """Events by hour and kind of a stream, as its windows close; the last day's are still open."""
    n = _written(plays.counts(_timed(v)), _place(v, "hours"))
    return n.select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n", F.round("value", 6).alias("value"))


#: The clock of the change feed, in milliseconds: when the second scan of it began.
NOW = 1_000_000_000


def _scans(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Albums' folders as files of two scans and a second look: some gone, some new, some grown, some still growing."""
    i = F.col("id")
    rows = v.album.select("root_id", "rel_path", "id")
    size = (i % 1000).cast("bigint")
    before = rows.filter(i % 5 != 0).select("root_id", "rel_path", size.alias("size"), (NOW - 100_000 - i).alias("mtime_ms"), (F.lit(1) + i % 2).alias("run"))
    touched = F.when(i % 3 == 0, NOW - i % 9000).otherwise(NOW - 100_000 - i)
    seen = rows.filter(i % 11 != 0).select("root_id", "rel_path", F.when(i % 7 == 0, size + 1).otherwise(size).alias("size"), touched.cast("bigint").alias("mtime_ms"), F.lit(3).cast("bigint").alias("run"), "id")
    again = seen.filter(i % 13 != 0).select("root_id", "rel_path", F.when(i % 4 == 0, F.col("size") + 5).otherwise(F.col("size")).alias("size"), "mtime_ms")
    closed = v.release.filter("id % 6 = 0").select("root_id", "rel_path")
    return before, seen.drop("id"), again, closed


def change_feed(v: Views) -> DataFrame:
    before, seen, again, closed = _scans(v)
    return changes.feed(before, seen, changes.moving(seen, again, NOW), closed)


def settled_inventory(v: Views) -> DataFrame:
    return changes.after(change_feed(v)).groupBy("root_id", "run").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime_ms").alias("newest"))


FEED_SQL = TABLES_SQL + f""", b as (
  select root_id, rel_path, id % 1000 as size, {NOW} - 100000 - id as mtime_ms, 1 + id % 2 as run from album where id % 5 <> 0
), a as (
  select root_id, rel_path, id % 1000 + case when id % 7 = 0 then 1 else 0 end as size, case when id % 3 = 0 then {NOW} - id % 9000 else {NOW} - 100000 - id end as mtime_ms, 3 as run, id from album where id % 11 <> 0
), h as (
  select root_id, rel_path from a where {NOW} - mtime_ms <= 5000 and (id % 13 = 0 or id % 4 = 0)
), c as (
  select root_id, rel_path from release where id % 6 = 0
), f as (
  select x.root_id, x.rel_path, case when h.rel_path is not null then 'held' when a.rel_path is null and exists (select 1 from c where c.root_id = x.root_id and (c.rel_path = x.rel_path or starts_with(x.rel_path, c.rel_path || '/'))) then 'closed'
    when a.rel_path is null then 'vanished' when b.rel_path is null then 'added' when a.size = b.size and a.mtime_ms = b.mtime_ms then 'same' else 'changed' end as state,
    a.size as a_size, a.mtime_ms as a_mtime, b.size as b_size, b.mtime_ms as b_mtime, b.run as b_run
  from (select root_id, rel_path from a union select root_id, rel_path from b) x left join a using (root_id, rel_path) left join b using (root_id, rel_path) left join h using (root_id, rel_path)
), feed as (
  select root_id, rel_path, state, cast(case when state in ('held', 'closed') then b_size else a_size end as bigint) as size, cast(case when state in ('held', 'closed') then b_mtime else a_mtime end as bigint) as mtime_ms,
    cast(case when state = 'held' then b_run when state <> 'vanished' then 3 end as bigint) as run from f)
"""
REQUESTS_SQL = """with recursive r as (
  select event_id as id, case when user_id % 7 <> 0 then 'k' || user_id % 20 end as key, event_type as method, cast(event_id % 2 as varchar) as path, ts as sent, epoch_ms(ts) as ms from events
), numbered as (
  select *, row_number() over (partition by key order by sent, id) as place from r where key is not null
), leap as (
  select a.key, a.place, min(b.place) as next from numbered a left join numbered b on a.key = b.key and b.place > a.place and b.ms - a.ms > 86400000 group by 1, 2
), fresh as (
  select key, place, next from leap where place = 1 union all select l.key, l.place, l.next from fresh f join leap l on l.key = f.key and l.place = f.next
), told as (
  select n.id, n.method, n.path, n.key, n.place, max(f.place) as known from numbered n join fresh f on f.key = n.key and f.place <= n.place group by 1, 2, 3, 4, 5
)
select t.id, case when t.place = t.known then 'fresh' when t.method = k.method and t.path = k.path then 'replay' else 'conflict' end as outcome, k.id as answered_by from told t join numbered k on k.key = t.key and k.place = t.known
union all select id, 'fresh', id from r where key is null"""


def queries() -> dict:
    return {
        "streamed_now_playing": (streamed_now_playing, "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type, max_by(ts, event_id) as ts from events group by 1"),
        "decided_requests": (decided_requests, REQUESTS_SQL),
        "hourly_plays": (hourly_plays, "select date_trunc('hour', ts) as starts, event_type, count(*) as n, round(sum(value), 6) as value from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 day"),
        "change_feed": (change_feed, FEED_SQL + "select * from feed"),
        "settled_inventory": (settled_inventory, FEED_SQL + "select root_id, run, count(*) as files, cast(sum(size) as bigint) as bytes, max(mtime_ms) as newest from feed where run is not null group by 1, 2"),
    }
