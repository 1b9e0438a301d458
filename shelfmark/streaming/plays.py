"""Play statistics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Events as they arrive in a folder of Parquet files, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Plays by window and kind; windows close once events are ``late`` behind."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("starts"), "event_type", "n", "value")
    )


def rollup(events: DataFrame) -> DataFrame:
    """Plays and the last play of each user, kept as state by user."""
    return events.groupBy("user_id").agg(F.count("*").alias("play_count"), F.max("ts").alias("played_at"))
