"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source gets the same expected number of copies, its source's target over its source's size.
Along a fixed order of the source's documents these expectations are summed up, one random offset is added, and a
document is emitted once for each integer that the running sum crosses. As documents are ordered by size, equal
stretches of every size are taken and a source's total comes within about one document of its target.

Defined results: a null or blank text has size 0; a null source is a source of its own, last in order; a source
without words gets target 0 and gives nothing; rows that repeat a doc_id each count; an empty table gives an empty
one. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

WEIGHTS, SHARE, CEILING, SEED = (3, 1, 2), 1.5, 2, "shelfmark-mix"
#: A source's documents are ordered by size class, then by one of so many parts. Running sums are taken over a class's
#: parts and over a source's classes, so no window holds a source's documents, or even all its strata.
PARTS_HEX = 2


def size_class(size: F.Column) -> F.Column:
    """Sizes up to 63 stand alone; from there on 32 classes for each doubling: below 2,000 classes for any bigint."""
    power = F.length(F.bin(size)) - 6
    return F.when(size < 64, size).otherwise(F.lit(64) + power * 32 + F.floor(size / F.pow(F.lit(2.0), power))).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """One row for each source: its size, its target. ``sizes`` has source and size.

    The shares rise together, as weight times a common level, until ``ceiling`` times the source's size stops one:
    then the level of the rest is what is left over their weights. Sources in order of ceiling over weight meet that
    level one by one, so that running sums find it without iteration. The window below is over one row a source.
    """
    everything = Window.orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_source = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("bigint"))
        .withColumn("cap", F.col("source_size") * ceiling)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(everything), F.lit(0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(everything), F.lit(0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(whole)["level"])
    )
    return by_source.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and n_copies of every row of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = keep(documents.select("doc_id", "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size")), "sizes")
    placed = sized.withColumns({"class": size_class(F.col("size")), "part": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, PARTS_HEX)})
    targets = source_targets(sized, weights, share, ceiling).withColumn(
        "offset", F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    )
    same = lambda a, b, *on: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in on))
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = keep(placed.groupBy("source", "class", "part").agg(F.count("*").alias("n")), "strata")
    classes = parts.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("before", earlier(["source"], "class"))
    inside = parts.withColumn("inside", earlier(["source", "class"], "part"))
    strata = (
        inside.alias("p").join(classes.alias("c"), same("p", "c", "source", "class"))
        .select("p.source", "p.class", "part", (F.col("before") + F.col("inside")).alias("before"))
    )
    starts = (
        strata.alias("s").join(targets.alias("t"), same("s", "t", "source"))
        .select("s.source", "s.class", "s.part", "before", "source_size", "target", "offset")
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "class", "part").orderBy("size", "doc_id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("before") + F.col("rank")
    copies = F.floor(F.col("offset") + rate * upto) - F.floor(F.col("offset") + rate * (upto - 1))
    return (
        ranked.alias("d").join(starts.alias("s"), same("d", "s", "source", "class", "part"))
        .select("doc_id", "d.size", "source_size", "target", copies.cast("bigint").alias("n_copies"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")
    )


#: The same in DuckDB's SQL; there one window can hold a whole source.
MIX_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as no from d group by source
), w as (
  select *, case no % 3 when 0 then 3 when 1 then 1 else 2 end as weight, source_size * 2 as cap from s
), r as (
  select *, cast(cap as double) / weight as ratio from w
), l as (
  select *,
    (cast(sum(source_size) over () as bigint) * cast(1.5 as double) - cast(coalesce(sum(cap) over (order by ratio, no rows between unbounded preceding and 1 preceding), 0) as bigint))
    / (cast(sum(weight) over () as bigint) - cast(coalesce(sum(weight) over (order by ratio, no rows between unbounded preceding and 1 preceding), 0) as bigint)) as level from r
), t as (
  select l.*, (select x.level from l x where x.level <= x.ratio order by x.ratio, x.no limit 1) as common,
    cast(cast('0x' || substr(md5('shelfmark-mix:' || coalesce(source, '')), 1, 8) as bigint) as double) / 4294967296.0::double as off from l
), g as (
  select source, source_size, least(cast(cap as double), common * weight) as target, off from t
), c as (
  select *, case when size < 64 then size else 64 + (length(bin(size)) - 6) * 32 + cast(floor(size / pow(2.0, length(bin(size)) - 6)) as bigint) end as class from d
), k as (
  select *, row_number() over (partition by source order by class, substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 2), size, doc_id) as rank from c
), e as (
  select k.doc_id, k.size, g.source_size, g.target, g.off, k.rank, case when g.source_size > 0 then g.target / g.source_size else 0.0 end as rate
  from k join g on k.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  size * cast(floor(off + rate * rank) - floor(off + rate * (rank - 1)) as bigint) as taken,
  cast(floor(off + rate * rank) - floor(off + rate * (rank - 1)) as bigint) as n_copies
from e
"""
