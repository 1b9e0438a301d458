"""Requests that may be sent twice: by key, the first is done, the same one again is a replay, another one a conflict."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long an answer can be asked for again.
KEEP = "24 hours"
KEEP_MS = 24 * 60 * 60 * 1000
_OUT = "key string, id bigint, at timestamp, outcome string, answered_by bigint"


def first_only(requests: DataFrame, keep: str = KEEP) -> DataFrame:
    """The requests to be done, where sending twice is all that happens: one a key, for as long as rows may be late."""
    return requests.withWatermark("at", keep).dropDuplicatesWithinWatermark(["key"])


def decided(requests: DataFrame, late: str = "1 hour", keep_ms: int = KEEP_MS) -> DataFrame:
    """Each of ``requests`` (id, key, method, path, at) as ``fresh``, ``replay`` or ``conflict``, with the request whose answer it gets.

    A request without a key (null or empty) is always fresh. What a key was first used for is kept until a request comes
    more than ``keep_ms`` after it; that one is fresh again. Within a batch requests are taken by time, then id. A key's
    state leaves the store once the watermark, ``late`` behind the newest, has passed its end.
    """
    schema = "id bigint, method string, path string, at bigint"
    keyless = F.col("key").isNull() | (F.col("key") == "")
    free = requests.filter(keyless).select("key", "id", "at", F.lit("fresh").alias("outcome"), F.col("id").alias("answered_by"))

    def decide(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(["at", "id"], kind="stable")
        known = state.get if state.exists else None
        outcome, by = [], []
        for id_, method, path, at in zip(rows["id"], rows["method"], rows["path"], rows["at"].astype("datetime64[ms]").astype("int64"), strict=True):
            if known is None or at - known[3] > keep_ms:
                known = (int(id_), method, path, int(at))
                outcome.append("fresh")
            else:
                outcome.append("replay" if (known[1], known[2]) == (method, path) else "conflict")
            by.append(known[0])
        state.update(known)
        state.setTimeoutTimestamp(max(known[3] + keep_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "at": rows["at"], "outcome": outcome, "answered_by": by})

    asked = requests.withWatermark("at", late).filter(~keyless).select("key", "id", "at", F.coalesce("method", F.lit("")).alias("method"), F.coalesce("path", F.lit("")).alias("path"))
    kept = asked.groupBy("key").applyInPandasWithState(decide, _OUT, schema, "append", GroupStateTimeout.EventTimeTimeout)
    return kept.unionByName(free.withWatermark("at", late))
