"""Who made an album: one credit of several sources, keys that spellings share, artists apart by folder, names in two alphabets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import col, marks_in
from shelfmark.functions.names import artist_name, split_credit
from shelfmark.operators.graph import groups
from shelfmark.sources.kept import stage

#: Sources of an album's credit, the strongest first.
SOURCES = ("cue", "folder", "tag")

#: The Latin spelling of each Cyrillic letter, and the letters that a simpler scheme writes in another way.
PRACTICAL = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g",
}
SIMPLER = {"й": "i", "х": "h", "ц": "c", "щ": "sh", "ю": "u", "я": "a"}


def has_cyrillic(text) -> F.Column:
    return col(text).rlike(r"\p{IsCyrillic}")


def latin_spellings(key) -> F.Column:
    """What a key with Cyrillic letters becomes under either scheme, as an array; empty for other keys."""
    letters = F.split(F.lower(col(key)), "")
    table = lambda scheme: F.create_map(*(F.lit(x) for pair in scheme.items() for x in pair))
    written = lambda scheme: F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table(scheme), c), c)), "")
    both = F.array_distinct(F.array(written(PRACTICAL), written({**PRACTICAL, **SIMPLER})))
    return F.when(has_cyrillic(key), both).otherwise(F.array().cast("array<string>"))


def credit_of_tags(tags: DataFrame) -> DataFrame:
    """(album_id, text) of ``tags`` (album_id, name, value, place): the first album artist, else the only artist, else the one name that all artists' credits share."""
    first = tags.filter("name = 'albumartist'").groupBy("album_id").agg(F.min_by("value", "place").alias("text"))
    artists = tags.filter("name = 'artist'").select("album_id", "value").distinct()
    n = artists.groupBy("album_id").agg(F.count("*").alias("credits"), F.min("value").alias("only"))
    named = artists.select("album_id", "value", F.explode(F.array_distinct(F.transform(split_credit("value"), lambda x: x["name"]))).alias("name")).filter("name <> ''")
    shared = named.groupBy("album_id", "name").agg(F.count("*").alias("in")).join(n, "album_id").filter(F.col("in") == F.col("credits"))
    one = shared.groupBy("album_id").agg(F.count("*").alias("names"), F.min("name").alias("name")).filter("names = 1").select("album_id", "name")
    by_artists = n.join(one, "album_id", "left").select("album_id", F.when(F.col("credits") == 1, F.col("only")).otherwise(F.col("name")).alias("text"))
    return first.join(by_artists.withColumnRenamed("text", "_t"), "album_id", "full").select("album_id", F.coalesce("text", "_t").alias("text")).filter("text IS NOT NULL")


def chosen(evidence: DataFrame) -> DataFrame:
    """(album_id, source, text): of ``evidence`` (album_id, source, place, text) the first text, by source then place, that names anybody."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    fit = evidence.filter((rank > 0) & (F.btrim(F.coalesce("text", F.lit(""))) != ""))
    return fit.groupBy("album_id").agg(F.min_by(F.struct("source", "text"), F.struct(rank, "place", "text")).alias("c")).select("album_id", "c.*")


def credited(credits: DataFrame) -> DataFrame:
    """(album_id, position, join_phrase, name, key, folded, stripped): the names of each credit; those that fold to nothing name nobody."""
    rows = credits.select("album_id", F.posexplode(split_credit("text")).alias("position", "e"))
    named = rows.select("album_id", "position", F.col("e.join_phrase").alias("join_phrase"), artist_name("e.name").alias("n"))
    return named.select("album_id", "position", "join_phrase", "n.name", "n.key", "n.folded", "n.stripped").filter("key <> ''")


def artist_folders(names: DataFrame, albums: DataFrame) -> DataFrame:
    """(album_id, key, root_path, folder): the outermost folder above the album whose own name has the key, the root (``''``) first.

    ``albums`` has album_id, root_path and rel_path. An album's own folder is no artist's; one that is its root has none.
    """
    parts = F.split("rel_path", "/")
    root = F.struct(F.lit(0).alias("depth"), F.lit("").alias("folder"), F.element_at(F.split(F.translate("root_path", "\\", "/"), "/"), -1).alias("said"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), F.get(parts, i - 1).alias("said")))
    inside = F.when(F.size(parts) > 1, above).otherwise(F.slice(above, 1, 0))
    folders = albums.filter("rel_path <> ''").select("album_id", "root_path", F.inline(F.concat(F.array(root), inside)))
    keys = folders.select("said").distinct().withColumn("key", artist_name("said")["key"])
    met = folders.join(keys, "said").join(names.select("album_id", "key").distinct(), ["album_id", "key"])
    return met.groupBy("album_id", "key").agg(F.min_by(F.struct("root_path", "folder"), "depth").alias("f")).select("album_id", "key", "f.*")


def artists_and_credits(credits: DataFrame, albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artists (key, base, name, sort_key, ambiguous, homonym, albums), and what each album's credit names (album_id, position, key, join_phrase).

    A key stands for one artist unless it has folders of its own in several places; these are artists ``key``, ``key#2``
    and so on, by root path and folder, and albums outside of them go to the first. The name shown carries the most
    accents, then is the most frequent, the shortest, the first.
    """
    names = stage(credited(credits), "names")
    placed = names.join(artist_folders(names, albums), ["album_id", "key"], "left")
    homes = placed.filter("folder IS NOT NULL").select("key", "root_path", "folder").distinct()
    # The folders of one name; their number is how often a collector filed the artist anew.
    numbered = homes.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("root_path", "folder")))
    split = numbered.groupBy("key").agg((F.max("place") > 1).alias("split"))
    owned = placed.join(numbered, ["key", "root_path", "folder"], "left").join(split, "key", "left")
    qualified = F.when(F.col("place") > 1, F.concat("key", F.lit("#"), F.col("place").cast("string"))).otherwise(F.col("key"))
    entries = stage(owned.withColumn("base", F.col("key")).withColumn("key", qualified).select("album_id", "position", "join_phrase", "name", "folded", "key", "base", "split"), "entries")
    spelt = entries.groupBy("key", "name").agg(F.count("*").alias("n"))
    shown = spelt.groupBy("key").agg(F.min_by("name", F.struct(-marks_in("name"), -F.col("n"), F.length("name"), "name")).alias("name"))
    folded = entries.groupBy("key", "folded").agg(F.lit(1).alias("_")).groupBy("key").agg(F.count("*").alias("forms"))
    of = entries.select("key", "base", "split", "album_id").distinct().groupBy("key", "base").agg(F.max("split").alias("split"), F.count("*").alias("albums"))
    both = of.join(shown, "key").join(folded, "key")
    homonym = F.coalesce("split", F.lit(False))
    artists = both.select("key", "base", "name", artist_name("name")["sort_key"].alias("sort_key"), ((F.col("forms") > 1) | homonym).alias("ambiguous"), homonym.alias("homonym"), "albums")
    return artists, entries.select("album_id", "position", "key", "join_phrase")


def twins(artists: DataFrame) -> DataFrame:
    """(key, latin): keys with Cyrillic letters and the keys without that either scheme may write for them; numbered homonyms have none."""
    plain = artists.filter(~F.col("key").contains("#")).select("key").distinct()
    spelt = plain.filter(has_cyrillic("key")).select("key", F.explode(latin_spellings("key")).alias("latin"))
    return spelt.join(plain.filter(~has_cyrillic("key")).select(F.col("key").alias("latin")), "latin", "left_semi").select("key", "latin")


def alphabets(artists: DataFrame) -> DataFrame:
    """(key, group): keys that may be one name, over any number of spellings; the smallest key names the group."""
    return groups(twins(artists).select(F.col("key").alias("a"), F.col("latin").alias("b"))).select(F.col("node").alias("key"), "group")
