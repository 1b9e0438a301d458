"""Tables between stages, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; only on one machine, where that is unset, a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors reach")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shelfmark-"))
    return spark.conf.get("spark.checkpoint.dir")


#: Whether Spark removes what a query has shuffled as soon as it has ended, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` as the table of a stage: written once, read by all that follow, and not lost with an executor.

    ``tidy``: small on disk, and what was shuffled for it goes as soon as it is written; for tables that nothing else is made with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shelfmark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path, compression="zstd" if tidy else None)
    finally:
        if tidy:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
