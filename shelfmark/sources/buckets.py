"""Tables in buckets of a key, of which a write replaces some: each write is a version, readers take each bucket's newest.

A version that was begun again is written over, and one that is not complete is not read, so writes can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions of a bucket that stay readable behind the newest.
VERSIONS = 2


class Buckets:
    """A table at ``path`` with rows of ``schema``; ``bucket`` says which of ``n`` buckets a row lies in, ``order`` how rows lie in a file."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket: Column, n: int, order: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.bucket, self.n, self.order = spark, path.rstrip("/"), schema, bucket.cast("int"), n, order

    def _files(self):
        names = self.spark._jvm.org.apache.hadoop.fs
        base = names.Path(self.path)
        return base.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), names.Path, base

    def versions(self) -> dict[int, list[int]]:
        """The complete versions of each bucket, by the names of folders."""
        fs, path, base = self._files()
        found: dict[int, list[int]] = {}
        for version in fs.listStatus(base) if fs.exists(base) else []:
            at, name = version.getPath(), version.getPath().getName()
            if name.startswith("version=") and fs.exists(path(at, "_SUCCESS")):
                for held in fs.listStatus(at):
                    if (inner := held.getPath().getName()).startswith("bucket="):
                        found.setdefault(int(inner[7:]), []).append(int(name[8:]))
        return found

    def read(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table, or what it was before a version, or some of its buckets."""
        paths = []
        for bucket, versions in self.versions().items():
            fit = [x for x in versions if before is None or x < before]
            if fit and (buckets is None or bucket in buckets):
                paths.append(f"{self.path}/version={max(fit)}/bucket={bucket}")
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of ``rows``: at most ``n``."""
        return {r[0] for r in rows.select(self.bucket).distinct().collect()}

    def write(self, rows: DataFrame, version: int, buckets: set[int], files: int | dict[int, int] = 1, keys: list[str] | None = None, added: str | None = None) -> None:
        """Make ``rows`` all there is of ``buckets``, as ``version``; each bucket is at most so many ``files``, for all alike or by bucket.

        Rows of equal ``keys``, if given, become one, with the sum of ``added``. What goes to a file meets in one task, so large buckets take several.
        """
        if not buckets:
            return
        names = self.schema.fieldNames()
        most = {b: max(1, files if isinstance(files, int) else files.get(b, 1)) for b in sorted(buckets)}
        first = {b: sum(list(most.values())[:i]) for i, b in enumerate(most)}
        of = lambda d: F.element_at(F.create_map(*(F.lit(x) for pair in d.items() for x in pair)), F.col("bucket"))
        part = F.pmod(F.xxhash64(*(keys or names)), of(most).cast("bigint")).cast("int")
        dealt = rows.select(*names, self.bucket.alias("bucket")).withColumn("_file", of(first) + part).repartition(sum(most.values()), "_file")
        if keys:
            dealt = dealt.groupBy("_file", "bucket", *keys).agg(F.sum(added).alias(added))
        dealt.select(*names, "bucket").sortWithinPartitions("bucket", *self.order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        fs, path, _ = self._files()
        for bucket in buckets:  # a bucket that lost its last row is empty, not what it was
            empty = path(f"{self.path}/version={version}/bucket={bucket}")
            if not fs.exists(empty):
                self.spark.createDataFrame([], self.schema).write.parquet(empty.toString())
        for bucket, versions in self.versions().items():
            if bucket in buckets:
                for old in sorted(versions)[: -1 - VERSIONS]:
                    fs.delete(path(f"{self.path}/version={old}/bucket={bucket}"), True)
