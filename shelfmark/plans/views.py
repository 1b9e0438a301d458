"""Views that the catalogue's queries share: record groups, their totals and genres, record and song listings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.tables import Tables, trimmed


def group_id() -> F.Column:
    """A box of several discs is one record; any other album is one of its own."""
    return F.when(F.col("release_id").isNull(), F.concat(F.lit("a"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("r"), F.col("release_id").cast("string")))


class Views(Tables):
    @cached_property
    def grp(self) -> DataFrame:
        """Albums with their group, its representative (first disc by number, path, id) and their place in it."""
        w = Window.partitionBy("group_id").orderBy(F.col("disc_number").isNull(), "disc_number", "rel_path", "id")
        return self.album.withColumn("group_id", group_id()).withColumn("rep_id", F.first("id").over(w)).withColumn("rn", F.row_number().over(w))

    @cached_property
    def grouped(self) -> DataFrame:
        """Albums with their group alone, where no representative is asked for: no window, no sort."""
        return self.album.withColumn("group_id", group_id())

    @cached_property
    def boxed(self) -> DataFrame:
        """Albums as in ``grp`` with what their release says: b_root, b_path, b_title, b_artist, b_year, null where they have none.

        Releases come by group, where albums are already; by release_id all albums without one would gather in one task.
        """
        said = {"root_id": "b_root", "rel_path": "b_path", "title": "b_title", "artist_id": "b_artist", "year": "b_year"}
        boxes = self.release.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("group_id"), *(F.col(c).alias(b) for c, b in said.items()))
        return self.grp.join(boxes, "group_id", "left")

    def totals(self, albums: DataFrame, tracks: DataFrame) -> DataFrame:
        """Songs and length of the groups of ``albums`` (id, group_id)."""
        per_album = tracks.groupBy("album_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
        return per_album.join(albums.select("id", "group_id"), F.col("album_id") == F.col("id")).groupBy("group_id").agg(F.sum("n").alias("song_count"), F.sum("ms").alias("duration_ms"))

    @cached_property
    def genre_values(self) -> DataFrame:
        """(file_id, position, value): genres without padding, blanks left out."""
        return self.file_tag.filter("name = 'genre'").select("file_id", "position", trimmed("value").alias("value")).filter("value <> ''")

    @cached_property
    def file_genre(self) -> DataFrame:
        """The first genre of each file."""
        return self.genre_values.groupBy("file_id").agg(F.min_by("value", "position").alias("value"))

    def genre1(self, albums: DataFrame, tracks: DataFrame) -> DataFrame:
        """The first genre of each group of ``albums``, in order of path and position; the smallest of each file is enough to know it."""
        first = self.genre_values.groupBy("file_id").agg(F.min(F.struct("position", "value")).alias("first"))
        files = first.join(self.file.select("id", "rel_path"), F.col("file_id") == F.col("id")).select("file_id", "rel_path", "first")
        groups = tracks.join(albums.select(F.col("id").alias("album_id"), "group_id"), "album_id").select("group_id", "file_id")
        by = F.struct("rel_path", F.col("first.position"), "file_id")
        return groups.join(files, "file_id").groupBy("group_id").agg(F.min_by("first.value", by).alias("value"))

    @cached_property
    def records(self) -> DataFrame:
        """One row a record: what a release says before what its representative says. Nothing that needs its songs."""
        g, a = self.boxed.filter("rn = 1").alias("g"), self.artist.alias("a")
        artist_id = F.coalesce("b_artist", "g.artist_id")
        return (
            g.join(a, F.col("a.id") == artist_id, "left")
            .select(
                "g.id", "g.group_id", F.coalesce("b_root", "g.root_id").alias("root_id"), F.coalesce("b_path", "g.rel_path").alias("rel_path"),
                F.coalesce("b_title", "g.title").alias("title"), artist_id.alias("artist_id"), F.col("a.name").alias("artist_name"), F.coalesce("b_year", "g.year").alias("year"), "g.junk_reason",
            )
        )

    def told(self, records: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
        """``records`` with songs, length and first genre, from the tracks of their albums."""
        t, x = self.totals(albums, tracks), self.genre1(albums, tracks).withColumnRenamed("value", "genre")
        return records.join(t, "group_id", "left").join(x, "group_id", "left").fillna(0, ["song_count", "duration_ms"])

    @cached_property
    def album_select(self) -> DataFrame:
        return self.told(self.records, self.grouped, self.track)

    def of_page(self, page: DataFrame) -> DataFrame:
        """The records of a page, told: only their own albums' tracks are read further. A page is a few hundred rows at most and meets as literals."""
        rows = page.collect()
        shown = self.spark.createDataFrame(rows, page.schema)
        albums = self.grouped.filter(F.col("group_id").isin([r["group_id"] for r in rows])).select("id", "group_id")
        return self.told(shown, albums, self.tracks(albums))

    @cached_property
    def song_select(self) -> DataFrame:
        return self.songs(self.track)

    def songs(self, tracks: DataFrame) -> DataFrame:
        """One row a song of ``tracks``; its artist's name is the representative's before the release's, its artist_id the reverse."""
        t, f, ro, g = tracks.alias("t"), self.file.alias("f"), self.root.alias("ro"), self.boxed.alias("g")
        a1, a2, x = self.artist.alias("a1"), self.artist.alias("a2"), self.file_genre.alias("x")
        on = lambda a, b: F.col(a) == F.col(b)
        return (
            t.join(f, on("f.id", "t.file_id")).join(ro, on("ro.id", "f.root_id")).join(g, on("g.id", "t.album_id"), "left")
            .join(a1, on("a1.id", "g.artist_id"), "left").join(a2, on("a2.id", "g.b_artist"), "left").join(x, on("x.file_id", "t.file_id"), "left")
            .select(
                "t.id", "t.album_id", "t.ordinal", "t.duration_ms", "f.rel_path", F.col("ro.path").alias("root_path"), "g.rep_id", F.coalesce("g.b_title", "g.title").alias("album_title"),
                F.coalesce("g.b_artist", "g.artist_id").alias("artist_id"), F.coalesce("a1.name", "a2.name").alias("artist_name"), F.coalesce("g.b_year", "g.year").alias("year"), F.col("x.value").alias("genre"), "g.junk_reason",
            )
        )
