"""Folders of a file inventory as parts of a library: roles, then releases, albums and the discs of a release.

What a folder is follows from its own files and from its direct children's, so a role needs no walk from the leaves up:
one aggregate over exploded ancestors says what each folder holds itself and beneath it, one over parents says what its
children hold, and a join hands a box's role down. Which release an album belongs to is the nearest of its ancestors that
decides it. No step loops over folders or levels; the depth of a path is its only factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import ancestors, basename, disc_marker, disc_number, folder_of, leading_number, natural_key, stated_discs, stem, without_disc_marker
from shelfmark.functions.folders import fields, pair_key

#: What a box set's folder is called.
BOX_WORDS = ("box", "set", "boxset")


def is_box_name(name) -> F.Column:
    return F.lower(F.regexp_replace(F.btrim(name), r"^(?i)(box)[ _-](set)$", "$1$2")).isin(*BOX_WORDS)


def held(files: DataFrame) -> DataFrame:
    """(root_id, rel_path, audio, pairs, deep) of every folder that ``files`` (root_id, folder, name, kind) name or imply, the root '' too.

    ``audio`` counts files of its own, ``pairs`` the stems of its own with one sheet and one audio file, ``deep`` any audio at or beneath it.
    """
    of = lambda k: F.count_if(F.col("kind") == k)
    stems = files.groupBy("root_id", "folder", pair_key("name").alias("stem")).agg(of("audio").alias("a"), of("cue").alias("c"))
    own = stems.groupBy("root_id", "folder").agg(F.sum("a").alias("audio"), F.count_if((F.col("a") == 1) & (F.col("c") == 1)).alias("pairs"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), ancestors("folder")))
    mine = lambda c: F.sum(F.when(F.col("rel_path") == F.col("folder"), F.col(c)).otherwise(0))
    return own.withColumn("rel_path", F.explode(above)).groupBy("root_id", "rel_path").agg(mine("audio").alias("audio"), mine("pairs").alias("pairs"), F.max(F.col("audio") > 0).alias("deep"))


def roles(files: DataFrame) -> DataFrame:
    """``held`` with each folder's role: box, disc, album, category or empty.

    A box has two pairs of its own, or as audio-bearing children at least two discs and nothing else, or at least two
    under a box's name, or as many as its name states, none of them named as a disc. A box known by its children makes
    them discs. Else audio of its own makes an album, audio beneath a category.
    """
    folder = held(files)
    child = folder.filter("rel_path <> '' AND audio > 0").select("root_id", folder_of("rel_path").alias("rel_path"), disc_number(basename("rel_path")).isNotNull().alias("disc"))
    children = child.groupBy("root_id", "rel_path").agg(F.count_if("disc").alias("discs"), F.count_if(~F.col("disc")).alias("others"))
    name = basename("rel_path")
    n = F.col("discs") + F.col("others")
    stated = stated_discs(name)
    by_children = ((F.col("discs") >= 2) & (F.col("others") == 0)) | (is_box_name(name) & (n >= 2)) | ((stated >= 2) & (n == stated) & (F.col("discs") == 0))
    known = folder.join(children, ["root_id", "rel_path"], "left").fillna(0, ["discs", "others"])
    known = known.withColumn("gives", (F.col("pairs") < 2) & F.coalesce(by_children, F.lit(False)))
    givers = known.filter("gives").select("root_id", F.col("rel_path").alias("parent"), F.lit(True).alias("given"))
    own = F.when((F.col("pairs") >= 2) | F.col("gives"), "box").when(F.col("audio") > 0, "album").when(F.col("deep"), "category").otherwise("empty")
    placed = known.withColumn("parent", F.when(F.col("rel_path") != "", folder_of("rel_path"))).join(givers, ["root_id", "parent"], "left")
    role = F.when(F.col("given") & (F.col("audio") > 0), "disc").otherwise(own)
    return placed.select("root_id", "rel_path", "parent", "audio", "pairs", "deep", role.alias("role"))


def disc_sets(tree: DataFrame) -> DataFrame:
    """(root_id, shelf, rel_path) of the discs of shelves that hold exactly one set: two or more discs that agree in front of their number."""
    name = basename("rel_path")
    key = F.btrim(F.regexp_replace(F.lower(without_disc_marker(name)), "[^a-z0-9]+", " "))
    shelf = tree.filter("role = 'category'").select("root_id", F.col("rel_path").alias("parent"))
    discs = tree.filter((F.col("audio") > 0) & disc_number(name).isNotNull()).join(shelf, ["root_id", "parent"], "left_semi").withColumn("key", key)
    sets = discs.groupBy("root_id", "parent", "key").agg(F.count("*").alias("n")).filter("n >= 2")
    one = sets.groupBy("root_id", "parent").agg(F.count("*").alias("sets"), F.min("key").alias("key")).filter("sets = 1").select("root_id", "parent", "key")
    return discs.join(one, ["root_id", "parent", "key"], "left_semi").select("root_id", F.col("parent").alias("shelf"), "rel_path")


def longest_common_prefix(text) -> F.Column:
    """The prefix that all texts of a group share: that of the smallest and the largest, both combined before the shuffle."""
    low, high = F.min(text), F.max(text)
    places = F.sequence(F.lit(1), F.least(F.length(low), F.length(high)) + 1)
    differ = F.filter(places, lambda i: F.substr(low, i, F.lit(1)) != F.substr(high, i, F.lit(1)))
    shared = F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, F.least(F.length(low), F.length(high)))
    return F.substr(low, F.lit(1), shared)


def snapped(prefix) -> F.Column:
    """A shared prefix that ends inside a bracket, cut back to the last dash between fields; nothing where there is none."""
    p = F.col(prefix) if isinstance(prefix, str) else prefix
    opened, closed = F.length(F.regexp_replace(p, r"[^(\[]", "")), F.length(F.regexp_replace(p, r"[^)\]]", ""))
    parts = fields(p)
    return F.when(opened <= closed, p).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " - "))


def flat_discs(files: DataFrame, tree: DataFrame) -> DataFrame:
    """(root_id, folder, name, disc_number, title) of the pairs in boxes of pairs: each is a disc, called by what is its own in its name.

    The number is the one stated, else the one that leads the name, else its place among the box's discs.
    """
    sheets, sound = (files.filter(F.col("kind") == k).select("root_id", "folder", "name", pair_key("name").alias("stem")) for k in ("cue", "audio"))
    one = sound.groupBy("root_id", "folder", "stem").agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n = 1")
    sheet = sheets.groupBy("root_id", "folder", "stem").agg(F.count("*").alias("n")).filter("n = 1").select("root_id", "folder", "stem")
    boxes = tree.filter("pairs >= 2").select("root_id", F.col("rel_path").alias("folder"))
    pairs = one.join(sheet, ["root_id", "folder", "stem"], "left_semi").join(boxes, ["root_id", "folder"], "left_semi").select("root_id", "folder", "name")
    pairs = pairs.withColumn("said", F.regexp_replace(stem("name"), r"^[0-9]+\s*[.\-_)\]]*\s*", ""))
    shared = pairs.groupBy("root_id", "folder").agg(longest_common_prefix("said").alias("shared")).withColumn("shared", snapped("shared"))
    own = F.regexp_replace(F.substr("said", F.length("shared") + 1), r"^[\s\-_.]+|[\s\-_.]+$", "")
    place = F.row_number().over(Window.partitionBy("root_id", "folder").orderBy(natural_key("name"), "name"))  # discs of one box
    named = pairs.join(shared, ["root_id", "folder"]).withColumn("place", place)
    title = F.when(own.rlike(r"\p{L}"), own).otherwise(stem("name"))
    return named.select("root_id", "folder", "name", F.coalesce(disc_marker("name"), leading_number("name"), "place").alias("disc_number"), title.alias("title"))


def _path(folder: str, name: str) -> F.Column:
    return F.when(F.col(folder) == "", F.col(name)).otherwise(F.concat(folder, F.lit("/"), F.col(name)))


def releases(tree: DataFrame) -> DataFrame:
    """(root_id, rel_path): boxes, and shelves that hold one set of discs."""
    return tree.filter("role = 'box'").select("root_id", "rel_path").union(disc_sets(tree).select("root_id", "shelf").distinct())


def albums(files: DataFrame, tree: DataFrame) -> DataFrame:
    """(root_id, rel_path, title, release_path, disc_number): one row for each album, disc or box with files that no disc claims.

    An album's release is that of the nearest folder above it that decides: a box takes all beneath it, a shelf only
    what lies at or beneath its discs, and keeps what it holds else from the boxes above.
    """
    flat = flat_discs(files, tree)
    discs = flat.select("root_id", _path("folder", "name").alias("rel_path"), "title", F.col("folder").alias("release_path"), "disc_number")
    claimed = flat.groupBy("root_id", F.col("folder").alias("rel_path")).agg(F.count("*").alias("taken"))
    boxes = tree.filter("role = 'box' AND audio > 0").join(claimed, ["root_id", "rel_path"], "left").filter("audio > coalesce(taken, 0)")
    none = F.lit(None)
    loose = boxes.select("root_id", "rel_path", basename("rel_path").alias("title"), none.cast("string").alias("release_path"), none.cast("int").alias("disc_number"))
    sets = disc_sets(tree)
    mine = tree.filter("role IN ('album', 'disc')").select("root_id", "rel_path", "role", "parent")
    parts = F.split("rel_path", "/")
    # Each folder above, with the child of it on the way down.
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct((i - 1).alias("depth"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("above"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("child")))
    above = mine.filter("rel_path <> ''").select("root_id", "rel_path", F.inline(up))
    box = tree.filter("role = 'box'").select("root_id", F.col("rel_path").alias("above"), F.lit(True).alias("box"))
    shelves = sets.select("root_id", F.col("shelf").alias("above")).distinct().withColumn("shelf", F.lit(True))
    member = sets.select("root_id", F.col("shelf").alias("above"), F.col("rel_path").alias("child"), F.lit(True).alias("member"))
    deciding = above.join(box.unionByName(shelves, allowMissingColumns=True), ["root_id", "above"]).join(member, ["root_id", "above", "child"], "left")
    takes = F.when(F.col("box") | F.col("member"), F.col("above"))
    nearest = deciding.groupBy("root_id", "rel_path").agg(F.max_by(F.struct(takes.alias("release_path")), "depth").alias("d")).select("root_id", "rel_path", "d.release_path")
    placed = mine.join(nearest, ["root_id", "rel_path"], "left")
    # A disc's place among its box's discs; boxes hold few.
    place = F.when(F.col("role") == "disc", F.row_number().over(Window.partitionBy("root_id", "parent", "role").orderBy("rel_path")))
    ranked = placed.filter("role = 'disc'").withColumn("place", place).unionByName(placed.filter("role = 'album'"), allowMissingColumns=True)
    number = F.when((F.col("role") == "disc") | F.col("release_path").isNotNull(), F.coalesce(disc_number(basename("rel_path")), "place"))
    folders = ranked.select("root_id", "rel_path", basename("rel_path").alias("title"), "release_path", number.cast("int").alias("disc_number"))
    return discs.unionByName(loose).unionByName(folders)
