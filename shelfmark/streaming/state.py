"""The latest state of each key under a stream: a table in buckets, each batch rewriting only the buckets it touches.

A batch's rows are folded to one a key before they meet the table. The new rows of a bucket are written beside the old
ones, under the batch's number; readers take each bucket's newest version. A batch that is run again after a failure
reads what was there before it and writes the same files again, so it counts once. Rows are compared by their order
column, so late and shuffled rows never undo newer ones. The table belongs to the query's checkpoint and lies inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.operators.keyed import last_of_each
from shelfmark.sources.buckets import Buckets

#: Pieces of a table's keys. A batch rewrites at most so many files' worth of keys as it has changed.
BUCKETS = 64


class KeyedState:
    """A table of the last row of each ``key``, by ``order`` (both lists of columns of ``schema``)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: list[str], order: list[str], buckets: int = BUCKETS):
        self.columns, self.key, self.order = schema.fieldNames(), key, order
        self.table = Buckets(spark, f"{folder.rstrip('/')}/table", schema, F.pmod(F.xxhash64(*key), F.lit(buckets)), buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def _last(self, rows: DataFrame) -> DataFrame:
        return last_of_each(rows.select(*self.columns).withColumn("_order", F.struct(*self.order)), self.key, "_order").select(*self.columns)

    def merge(self, batch: DataFrame, version: int) -> None:
        """Fold ``batch`` into the table as ``version``."""
        new = self._last(batch).persist()
        touched = self.table.touched(new)
        self.table.write(self._last(self.table.read(version, touched).unionByName(new)), version, touched)
        new.unpersist()


def latest(stream: DataFrame, checkpoint: str, key: list[str], order: list[str], buckets: int = BUCKETS, **trigger) -> tuple[StreamingQuery, KeyedState]:
    """Start keeping the last row of each key of ``stream``; the state can be read at any time."""
    state = KeyedState(stream.sparkSession, f"{checkpoint.rstrip('/')}/latest", stream.schema, key, order, buckets)
    query = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return query, state
