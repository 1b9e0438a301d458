"""Keyed writes as folds over DataFrames: the new table is computed, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import ancestors


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: tuple[str, ...] = (), keep_known: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``key`` (not null, unique on either side).

    Columns in ``keep_old`` stay as they were once set; those in ``keep_known`` change unless the new value is null.
    """
    present = F.col("n._in").isNotNull()
    o, n = old.withColumn("_in", F.lit(1)).alias("o"), new.withColumn("_in", F.lit(1)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")

    def column(c: str):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key or c in keep_old:
            return F.coalesce(a, b)
        return F.coalesce(b, a) if c in keep_known else F.when(present, b).otherwise(a)

    return joined.select(*(column(c).alias(c) for c in old.columns))


def upsert_where(old: DataFrame, new: DataFrame, key: list[str], when: F.Column) -> DataFrame:
    """``old`` with new keys put in; rows of known keys change only where ``when``, over columns ``o.*`` and ``n.*``, holds."""
    o, n = old.withColumn("_in", F.lit(1)).alias("o"), new.withColumn("_in", F.lit(1)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    take = F.col("o._in").isNull() | (F.col("n._in").isNotNull() & F.coalesce(when, F.lit(False)))
    return joined.select(*((F.coalesce(f"o.{c}", f"n.{c}") if c in key else F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns))


def counted_in(old: DataFrame, log: DataFrame, key: list[str], order: str, last: str, count: str) -> DataFrame:
    """Counters after a log: ``count`` grows by the log's rows of the key, ``last`` becomes that of the last row in call order; other columns stay."""
    more = log.groupBy(*key).agg(F.count("*").alias("_more"), F.max_by(F.struct(F.col(last).alias("v")), order).alias("_last"))
    new = {count: F.coalesce(count, F.lit(0)) + F.coalesce("_more", F.lit(0)), last: F.when(F.col("_last").isNull(), F.col(last)).otherwise(F.col("_last.v"))}
    return old.join(more, key, "full").select(*(new[c].alias(c) if c in new else F.col(c) for c in old.columns))


def with_new_members(dimension: DataFrame, names: DataFrame, name: str, number: str) -> DataFrame:
    """A dimension with names it does not know yet, numbered on from its largest number in order of name.

    New names are numbered within ranges of the name and ranges are counted before, so no task holds them all.
    """
    new = names.select(name).filter(F.col(name).isNotNull()).distinct().join(dimension, name, "left_anti")
    ranged = new.withColumn("_range", F.substring(F.sha2(F.col(name), 256), 1, 2))
    top = dimension.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # 256 rows at most
    place = F.row_number().over(Window.partitionBy("_range").orderBy(name))
    numbered = ranged.join(F.broadcast(before), "_range").join(F.broadcast(top)).select(name, (F.col("_top") + F.col("_before") + place).alias(number))
    return dimension.select(name, number).unionByName(numbered)


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` with the first row, by ``order``, of each key that it lacks; what it has stays."""
    rest = [c for c in old.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("s")).select(*key, "s.*")
    return old.unionByName(first.join(old, key, "left_anti").select(*old.columns))


def replaced_lists(old: DataFrame, new: DataFrame, list_key: str) -> DataFrame:
    """Lists of which ``new`` has any row are exchanged for it; others stay."""
    return old.join(new.select(list_key).distinct(), list_key, "left_anti").unionByName(new.select(*old.columns))


def swept_trees(rows: DataFrame, seen: DataFrame, kept: DataFrame, on: list[str] = ()) -> DataFrame:
    """``rows`` (``on``, rel_path) that were seen or lie in a subtree of ``kept`` (``on``, folder): ancestors meet by equality, once a row.

    ``on`` holds what tells the trees apart, such as their roots.
    """
    key = [*on, "rel_path"]
    held = rows.select(*key, F.explode(ancestors("rel_path")).alias("folder")).join(kept, [*on, "folder"], "left_semi").select(*key)
    return rows.join(seen.select(*key).union(held), key, "left_semi")


def cascaded(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (each with id) without the rows ``gone`` (id) of the first one and all that hang on them.

    ``links`` are (child, column, parent) in order from the top; rows without a parent stay.
    """
    first = next(iter(tables))
    out = tables | {first: tables[first].join(gone, "id", "left_anti")}
    for child, column, parent in links:
        lost = tables[parent].select("id").join(out[parent].select("id"), "id", "left_anti").withColumnRenamed("id", column)
        out[child] = out[child].join(lost, column, "left_anti").select(*tables[child].columns)
    return out


def documents_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One JSON document a key: its rows as an ordered array."""
    rest = [order, *(c for c in rows.columns if c not in (key, order))]
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("document"))


def restored(documents: DataFrame, key: str, schema: str, known: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of exported documents that find their place in ``known`` (columns ``on``), and those that do not."""
    rows = documents.select(key, F.inline(F.from_json("document", schema)))
    return rows.join(known.select(*on).distinct(), on, "left_semi"), rows.join(known.select(*on).distinct(), on, "left_anti")


def last_of_each(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: an append-only log folded to its present state, combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*key, "s.*")


def compare(before: DataFrame, after: DataFrame, key: list[str], watched: list[str]) -> DataFrame:
    """Every key of two snapshots with its state: added, vanished, changed or same."""
    b, a = before.select(*key, F.struct(*watched).alias("b")), after.select(*key, F.struct(*watched).alias("a"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "vanished").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return b.join(a, key, "full").select(*key, state.alias("state"))


def swept(rows: DataFrame, seen: DataFrame, key: list[str], held: DataFrame | None = None) -> DataFrame:
    """``rows`` without those that vanished from ``seen``; ``held`` (the same key) names some that stay all the same."""
    alive = seen.select(*key) if held is None else seen.select(*key).union(held.select(*key))
    return rows.join(alive, key, "left_semi")


def removed_and_appended(entries: DataFrame, list_key: str, remove: list[int], append: DataFrame) -> DataFrame:
    """Ordered lists after taking out old positions, putting ``append`` (list, position, item) at the end, and renumbering."""
    kept = entries.filter(~F.col("position").isin(remove)).withColumn("part", F.lit(0))
    both = kept.unionByName(append.withColumn("part", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(list_key).orderBy("part", "position")) - 1
    return both.withColumn("position", place).drop("part")
