"""What users made, written as documents by what tracks are on disk, and merged into another library's state.

A document names tracks by root, file and, for a cut of a longer file, where it begins; ids mean nothing elsewhere. What
finds no track or place is listed with the reason; nothing that is there already goes away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIST = "struct<name: string, comment: string, entries: array<struct<root: string, file: string, at: bigint>>>"
STAR = "struct<root: string, file: string, at: bigint, starred_at: string, rating: int>"
MARK = "struct<root: string, rel: string, verdict: string, note: string, marked_at: string>"
#: Entries of a list that are numbered in one piece.
PIECE = 10_000


def exported(tracks: DataFrame, lists: DataFrame, entries: DataFrame, stars: DataFrame, marks: DataFrame) -> DataFrame:
    """(kind, seq, body): a JSON document for each list, star and mark. ``tracks`` has id, root, file, at; the others name tracks by ``track_id``."""
    key = tracks.select(F.col("id").alias("track_id"), F.struct("root", "file", "at").alias("key"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "key"))), lambda x: x["key"])
    of = entries.join(key, "track_id").groupBy("list_id").agg(ordered.alias("entries"))
    empty = F.array().cast("array<struct<root:string,file:string,at:bigint>>")
    list_ = lists.join(of, F.col("id") == F.col("list_id"), "left").select(F.lit("list").alias("kind"), F.col("id").cast("bigint").alias("seq"), F.to_json(F.struct("name", "comment", F.coalesce("entries", empty).alias("entries"))).alias("body"))
    star = stars.join(key, "track_id").select(F.lit("star"), F.col("track_id").cast("bigint"), F.to_json(F.struct("key.root", "key.file", "key.at", "starred_at", "rating")))
    mark = marks.select(F.lit("mark"), F.monotonically_increasing_id(), F.to_json(F.struct("root", "rel", "verdict", "note", "marked_at")))
    return list_.union(star).union(mark)


def _found(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """``rows`` (root, file, at) with the track_id of their track, null where the library has none."""
    keys = tracks.select(F.col("id").alias("track_id"), "root", "file", F.coalesce("at", F.lit(-1)).alias("_at"))
    return rows.withColumn("_at", F.coalesce("at", F.lit(-1))).join(keys, ["root", "file", "_at"], "left").drop("_at")


def restored_lists(documents: DataFrame, tracks: DataFrame, lists: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists (id, name, comment), entries (list_id, position, track_id), and what was skipped (what, why).

    A list of a known name goes on after its last entry; unknown names become new lists, numbered on by name. Documents
    of one name follow one another. Entries keep their order, and those that are skipped leave no gap.
    """
    said = documents.filter("kind = 'list'").select("seq", F.from_json("body", LIST).alias("d")).filter("d.name IS NOT NULL").select("seq", "d.*")
    new = said.join(lists.select("name"), "name", "left_anti").groupBy("name").agg(F.min_by(F.struct("comment"), "seq").alias("c")).select("name", "c.comment")
    top = lists.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    piece = F.substring(F.sha2("name", 256), 1, 2)
    counts = new.groupBy(piece.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    numbered = new.withColumn("_p", piece).join(F.broadcast(counts), "_p").join(F.broadcast(top))
    made = numbered.select((F.col("_top") + F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("name"))).cast("bigint").alias("id"), "name", "comment")
    every = lists.select(F.col("id").cast("bigint").alias("id"), "name", "comment").union(made)
    rows = said.select("seq", "name", F.posexplode("entries").alias("i", "e")).select("seq", "name", "i", "e.*")
    met = _found(rows, tracks)
    skipped = met.filter("track_id IS NULL").select(F.concat("name", F.lit(": "), "file").alias("what"), F.lit("no such file or segment here").alias("why"))
    fit = met.filter("track_id IS NOT NULL").withColumn("_piece", F.floor(F.col("i") / PIECE))
    sizes = fit.groupBy("name", "seq", "_piece").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("name").orderBy("seq", "_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each piece
    start = entries.groupBy("list_id").agg((F.max("position") + 1).alias("_next"))
    place = F.row_number().over(Window.partitionBy("name", "seq", "_piece").orderBy("i")) - 1
    placed = fit.withColumn("_place", place).join(sizes.withColumn("_before", before).drop("_n"), ["name", "seq", "_piece"]).join(every.select(F.col("id").alias("list_id"), "name"), "name").join(start, "list_id", "left")
    added = placed.select("list_id", (F.coalesce("_next", F.lit(0)) + F.col("_before") + F.col("_place")).cast("bigint").alias("position"), F.col("track_id").cast("bigint").alias("track_id"))
    return every, entries.select(F.col("list_id").cast("bigint"), F.col("position").cast("bigint"), F.col("track_id").cast("bigint")).union(added), skipped


def restored_stars(documents: DataFrame, tracks: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stars (track_id, starred_at, rating), a document's in place of what was there and the last of several; and what was skipped."""
    said = documents.filter("kind = 'star'").select("seq", F.from_json("body", STAR).alias("d")).select("seq", "d.*").filter("file IS NOT NULL")
    met = _found(said, tracks)
    new = met.filter("track_id IS NOT NULL").groupBy("track_id").agg(F.max_by(F.struct("starred_at", "rating"), "seq").alias("s")).select("track_id", "s.*")
    kept = stars.join(new.select("track_id"), "track_id", "left_anti").select("track_id", "starred_at", "rating")
    return kept.union(new), met.filter("track_id IS NULL").select(F.concat(F.lit("star: "), "file").alias("what"), F.lit("no such file or segment here").alias("why"))


def restored_marks(documents: DataFrame, roots: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks (root_id, rel_path, verdict, note) by folder, a document's in place of what was there; and those of roots that ``roots`` (id, path) lacks."""
    said = documents.filter("kind = 'mark'").select("seq", F.from_json("body", MARK).alias("d")).select("seq", "d.*").filter("rel IS NOT NULL")
    met = said.join(roots.select(F.col("id").alias("root_id"), F.col("path").alias("root")), "root", "left")
    new = met.filter("root_id IS NOT NULL").groupBy("root_id", F.col("rel").alias("rel_path")).agg(F.max_by(F.struct("verdict", "note"), "seq").alias("s")).select("root_id", "rel_path", "s.*")
    kept = marks.join(new.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_anti").select("root_id", "rel_path", "verdict", "note")
    return kept.union(new), met.filter("root_id IS NULL").select(F.concat(F.lit("mark: "), "rel").alias("what"), F.lit("no such root here").alias("why"))
