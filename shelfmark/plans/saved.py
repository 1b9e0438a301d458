"""Export, another library, restore: rows compared, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import restore
from shelfmark.plans.views import Views
from shelfmark.sources.kept import stage


def _tracks(v: Views, there: bool) -> DataFrame:
    """Parts as tracks, every fourth a cut; the other library lacks every fifth and has ids of its own."""
    p = F.col("p_partkey")
    rows = v.read("part").filter(p % 5 != 0) if there else v.read("part")
    return rows.select((p + 100_000 if there else p).alias("id"), F.concat(F.lit("/r"), (p % 3).cast("string")).alias("root"), F.concat(F.lit("p"), p.cast("string"), F.lit(".flac")).alias("file"), F.when(p % 4 == 0, p * 1000).alias("at"))


def _documents(v: Views) -> DataFrame:
    """Conversations as lists of tracks, every seventh track starred, and folders of customers marked."""
    c = v.read("conversations")
    lists = c.select(F.col("conv_id").alias("id")).distinct().select("id", F.concat(F.lit("list "), F.col("id").cast("string")).alias("name"), F.lit("theirs").alias("comment"))
    entries = c.select(F.col("conv_id").alias("list_id"), F.col("turn").alias("position"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 150).alias("track_id"))
    stars = v.read("part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("track_id"), F.concat(F.lit("2024-"), F.col("p_partkey").cast("string")).alias("starred_at"), (F.col("p_size") % 5).cast("int").alias("rating"))
    marks = v.read("customer").select(F.concat(F.lit("/r"), (F.col("c_custkey") % 5).cast("string")).alias("root"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("rel"), F.when(F.col("c_custkey") % 2 == 0, "junk").otherwise("fine").alias("verdict"), F.col("c_name").alias("note"), F.lit("2024").alias("marked_at"))
    return stage(restore.exported(_tracks(v, False), lists, entries, stars, marks), "documents")


def _lists(v: Views) -> tuple[DataFrame, DataFrame]:
    """Of the other library: lists of the even conversations, with two entries each."""
    c = v.read("conversations").filter("conv_id % 2 = 0").select("conv_id").distinct()
    return c.select(F.col("conv_id").alias("id"), F.concat(F.lit("list "), F.col("conv_id").cast("string")).alias("name"), F.lit("ours").alias("comment")), c.select(F.col("conv_id").alias("list_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("position"), F.lit(100_001).alias("track_id"))


def restored_lists(v: Views) -> DataFrame:
    every, entries, _ = restore.restored_lists(_documents(v), _tracks(v, True), *_lists(v))
    return entries.join(every.select(F.col("id").alias("list_id"), "name", "comment"), "list_id").select("name", "comment", "position", "track_id")


def skipped_entries(v: Views) -> DataFrame:
    docs = _documents(v)
    *_, lists = restore.restored_lists(docs, _tracks(v, True), *_lists(v))
    _, stars = restore.restored_stars(docs, _tracks(v, True), _stars(v))
    _, marks = restore.restored_marks(docs, _roots(v), _marks(v))
    return lists.union(stars).union(marks)


def _stars(v: Views) -> DataFrame:
    return v.read("part").filter("p_partkey % 5 <> 0 AND p_partkey % 3 = 0").select((F.col("p_partkey") + 100_000).alias("track_id"), F.lit("ours").alias("starred_at"), F.lit(None).cast("int").alias("rating"))


def restored_stars(v: Views) -> DataFrame:
    return restore.restored_stars(_documents(v), _tracks(v, True), _stars(v))[0]


def _roots(v: Views) -> DataFrame:
    return v.read("region").filter("r_regionkey < 4").select((F.col("r_regionkey") + 10).alias("id"), F.concat(F.lit("/r"), F.col("r_regionkey").cast("string")).alias("path"))


def _marks(v: Views) -> DataFrame:
    return v.read("supplier").select((F.col("s_suppkey") % 4 + 10).alias("root_id"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("rel_path"), F.lit("old").alias("verdict"), F.lit("ours").alias("note"))


def restored_marks(v: Views) -> DataFrame:
    return restore.restored_marks(_documents(v), _roots(v), _marks(v))[0]


SAVED_SQL = """with entry as (
  select conv_id, turn, (conv_id * 7 + turn * 3) % 150 as p, row_number() over (partition by conv_id order by turn) as i from conversations where (conv_id * 7 + turn * 3) % 150 in (select p_partkey from part)
), fit as (
  select *, row_number() over (partition by conv_id order by turn) - 1 as place from entry where p % 5 <> 0
)
"""


def queries() -> dict:
    return {
        "restored_lists": (restored_lists, SAVED_SQL + "select 'list ' || conv_id as name, case when conv_id % 2 = 0 then 'ours' else 'theirs' end as comment, cast(place + case when conv_id % 2 = 0 then 2 else 0 end as bigint) as position, cast(p + 100000 as bigint) as track_id from fit union all select distinct 'list ' || conv_id, 'ours', cast(i as bigint), cast(100001 as bigint) from conversations, (select unnest([0, 1]) as i) where conv_id % 2 = 0"),
        "skipped_entries": (skipped_entries, SAVED_SQL + "select 'list ' || conv_id || ': p' || p || '.flac' as what, 'no such file or segment here' as why from entry where p % 5 = 0 union all select 'star: p' || p_partkey || '.flac', 'no such file or segment here' from part where p_partkey % 35 = 0 union all select 'mark: c' || c_custkey, 'no such root here' from customer where c_custkey % 5 = 4"),
        "restored_stars": (restored_stars, "select p_partkey + 100000 as track_id, case when p_partkey % 7 = 0 then '2024-' || p_partkey else 'ours' end as starred_at, case when p_partkey % 7 = 0 then p_size % 5 end as rating from part where p_partkey % 5 <> 0 and (p_partkey % 7 = 0 or p_partkey % 3 = 0)"),
        "restored_marks": (restored_marks, "select cast(coalesce(n.root_id, o.root_id) as int) as root_id, coalesce(n.rel_path, o.rel_path) as rel_path, case when n.rel_path is null then 'old' else n.verdict end as verdict, case when n.rel_path is null then 'ours' else n.note end as note from (select c_custkey % 5 + 10 as root_id, 'c' || c_custkey as rel_path, case when c_custkey % 2 = 0 then 'junk' else 'fine' end as verdict, c_name as note from customer where c_custkey % 5 < 4) n full join (select s_suppkey % 4 + 10 as root_id, 'c' || s_suppkey as rel_path from supplier) o on o.root_id = n.root_id and o.rel_path = n.rel_path"),
    }
