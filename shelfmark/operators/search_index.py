"""A search index that is kept: postings in buckets of their words' beginnings, replaced where rows change, ranked from what it holds.

A question reads the buckets of its own words and one row of totals. A change reads which buckets the changed rows lie in
and writes these anew, so the work follows the change and not the index. Ranks are those of ``search.ranked``: BM25 over
a row's columns as one text, all words required, the last as a prefix.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from shelfmark.operators.search import K1, B, words_of
from shelfmark.sources.buckets import Buckets
from shelfmark.sources.kept import stage

#: Buckets of words and of rows; leading characters that decide a word's bucket; files of a bucket at least, and words from which on it has more.
BUCKETS, HEAD, FILES, FILE_ROWS = 64, 2, 1, 2_000_000


class SearchIndex:
    """An index at ``folder`` over rows with a unique key."""

    def __init__(self, spark: SparkSession, folder: str, key: DataType | None = None, buckets: int = BUCKETS, files: int = FILES):
        self.spark, self.n, self.files = spark, buckets, files
        k = StructField("key", key or LongType())
        self.bucket_of = lambda word: F.pmod(F.crc32(F.encode(F.left(word, F.lit(HEAD)), "UTF-8")), F.lit(buckets)).cast("int")
        self.postings = Buckets(spark, f"{folder}/postings", StructType([StructField("word", StringType()), k, StructField("hits", LongType()), StructField("length", LongType())]), self.bucket_of(F.col("word")), buckets, ("word", "key"))
        self.rows = Buckets(spark, f"{folder}/rows", StructType.fromDDL("length bigint, buckets array<int>").add(k), F.pmod(F.xxhash64("key"), F.lit(buckets)), buckets)
        self.totals = Buckets(spark, f"{folder}/totals", StructType.fromDDL("rows bigint, words bigint"), F.lit(0), 1)

    def update(self, rows: DataFrame, key: str, columns: list[str], version: int, gone: DataFrame | None = None) -> None:
        """Put ``rows`` in, in place of what their keys had, and take the keys of ``gone`` (``key``) out. Versions rise; one may be repeated."""
        cut = rows.select(F.col(key).alias("key"), words_of(F.concat_ws(" ", *columns)).alias("w"))
        said = stage(cut, "said").withColumn("length", F.size("w").cast("bigint"))  # texts are cut once, and words are counted from there
        forward = said.select("key", "length", F.array_distinct(F.transform("w", self.bucket_of)).alias("buckets"))
        changed = said.select("key") if gone is None else said.select("key").union(gone.select(F.col(key).alias("key"))).distinct()
        places = self.rows.touched(changed)
        was = self.rows.read(version, places)
        lost = {r[0] for r in was.join(changed, "key", "left_semi").select(F.explode("buckets")).distinct().collect()}  # at most n
        each = said.select("key", "length", F.explode("w").alias("word"))
        new = {r[0]: r[1] for r in each.groupBy(self.bucket_of(F.col("word"))).count().collect()}  # at most n
        touched = lost | set(new)
        names = self.postings.schema.fieldNames()
        kept = self.postings.read(version, touched).join(changed, "key", "left_anti").select(*names)
        old = {r[0]: r[1] for r in kept.groupBy(self.bucket_of(F.col("word"))).count().collect()}
        files = {b: max(self.files, -(-(new.get(b, 0) + old.get(b, 0)) // FILE_ROWS)) for b in touched}
        once = each.withColumn("hits", F.lit(1).cast("bigint")).select(*names)
        self.postings.write(kept.unionByName(once), version, touched, files, ["word", "key", "length"], "hits")
        self.rows.write(was.join(changed, "key", "left_anti").unionByName(forward, allowMissingColumns=True), version, places)
        self.totals.write(self.rows.read().agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")), version, {0})

    def read_for(self, words: list[str]) -> DataFrame:
        """The postings in the buckets that ``words``, the last as a prefix, can lie in."""
        bucket = lambda w: zlib.crc32(w[:HEAD].encode()) % self.n
        wanted = None if len(words[-1]) < HEAD else {bucket(w) for w in words}
        return self.postings.read(buckets=wanted)

    def search(self, words: list[str]) -> DataFrame:
        """(key, rank) of the rows that hold all ``words`` (as ``words_of`` makes them), the smaller the rank the better; none for no words."""
        if not words:
            return self.postings.read().limit(0).select("key", F.lit(0.0).alias("rank"))
        tests = [F.col("word").startswith(w) if i == len(words) - 1 else F.col("word") == w for i, w in enumerate(words)]
        some = self.read_for(words).filter(reduce(lambda a, b: a | b, tests))
        each = some.groupBy("key").agg(F.max("length").alias("length"), *(F.sum(F.when(t, F.col("hits")).otherwise(0)).alias(f"h{i}") for i, t in enumerate(tests)))
        totals = self.totals.read().first()
        have = each.agg(*(F.count_if(F.col(f"h{i}") > 0).alias(f"n{i}") for i in range(len(words)))).first()
        long = totals["words"] / max(totals["rows"], 1) or 1.0 if totals else 1.0
        score = F.lit(0.0)
        for i in range(len(words)):
            n, h = have[f"n{i}"], F.col(f"h{i}")
            weight = max(1e-6, math.log(((totals["rows"] if totals else 0) - n + 0.5) / (n + 0.5)))
            score = score - F.lit(weight) * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("length") / F.lit(long)))
        return each.filter(reduce(lambda a, b: a & b, [F.col(f"h{i}") > 0 for i in range(len(words))])).select("key", score.alias("rank"))
