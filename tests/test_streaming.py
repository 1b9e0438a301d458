"""Streams against batches: replays, restarts, late rows, duplicates across batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes, keyed
from shelfmark.sources import buckets
from shelfmark.streaming import plays, requests, state
from tests.conftest import SF


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def put(df, folder, n):
    """``df`` shuffled into ``n`` files that arrive one after another."""
    parts = df.withColumn("_p", F.pmod(F.xxhash64("event_id"), F.lit(n))).persist()
    for i in range(n):
        yield lambda i=i: parts.filter(F.col("_p") == i).drop("_p").orderBy(F.desc(F.xxhash64("event_id", F.lit(1)))).coalesce(1).write.mode("append").parquet(folder)


def test_latest_state_of_shuffled_events_and_a_restart(spark, tmp_path):
    rows = events(spark).select("user_id", "event_id", "event_type", "ts")
    want = {tuple(r) for r in keyed.last_of_each(rows, ["user_id"], "event_id").select(*rows.columns).collect()}
    arrivals = list(put(rows, f"{tmp_path}/in", 5))

    def go():
        query, kept = state.latest(plays.read(spark, f"{tmp_path}/in", rows.schema, 1), f"{tmp_path}/ck", ["user_id"], ["event_id"], 4)
        query.awaitTermination()
        return query, kept

    for arrive in arrivals[:3]:
        arrive()
    _, kept = go()
    assert {tuple(r) for r in kept.read().collect()} != want
    for arrive in arrivals[3:]:
        arrive()
    query, kept = go()  # a new query goes on from the checkpoint
    assert {tuple(r) for r in kept.read().collect()} == want and query.lastProgress["batchId"] >= 4
    last = max(x for versions in kept.table.versions().values() for x in versions)
    kept.merge(rows.filter("event_id % 3 = 0"), last)  # a batch that is run again
    kept.merge(rows.filter("event_id % 3 = 0"), last)
    kept.merge(rows, last + 1)
    assert {tuple(r) for r in kept.read().collect()} == want
    assert all(len(x) <= buckets.VERSIONS + 1 for x in kept.table.versions().values())


def test_state_of_nothing(spark, tmp_path):
    kept = state.KeyedState(spark, str(tmp_path), events(spark).schema, ["user_id"], ["event_id"])
    kept.merge(events(spark).limit(0), 0)
    assert kept.read().count() == 0


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = events(spark)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = plays.counts(plays.read(spark, f"{tmp_path}/in", rows.schema, 3))
    stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    end = rows.agg(F.max("ts")).first()[0] - timedelta(days=1)
    want = rows.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("*").alias("n")).collect()
    assert {(r["starts"], r["event_type"], r["n"]) for r in spark.table("hours").collect()} == {(r["h"], r["event_type"], r["n"]) for r in want if r["h"] + timedelta(hours=1) <= end}


START = datetime(2024, 1, 1)
REQUEST = "id bigint, key string, method string, path string, at timestamp"


def asked(*rows):
    return [(i, key, method, path, START + timedelta(hours=hours)) for i, key, method, path, hours in rows]


@pytest.fixture
def run(spark, tmp_path):
    """Batches of requests through a stream, one file each; what was decided."""

    def go(decide, *batches):
        found = []
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = decide(spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in"))
            stream.writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return found

    return go


def test_requests_sent_again(run):
    found = run(
        requests.decided,
        asked((1, "a", "PUT", "/x", 0), (2, "a", "PUT", "/x", 0.5), (3, None, "PUT", "/x", 0), (4, "", "PUT", "/x", 0), (5, "b", None, "/y", 0.1)),
        asked((6, "a", "PUT", "/x", 2), (7, "a", "PUT", "/z", 2.5), (8, "b", None, "/y", 2)),
        asked((9, "c", "GET", "/", 23), (10, "a", "POST", "/x", 23.5)),
        asked((11, "a", "PUT", "/z", 24.5), (12, "a", "PUT", "/x", 25), (13, "a", "PUT", "/z", 30)),
    )
    assert {r["id"]: (r["outcome"], r["answered_by"]) for r in found} == {
        1: ("fresh", 1), 2: ("replay", 1), 3: ("fresh", 3), 4: ("fresh", 4), 5: ("fresh", 5), 6: ("replay", 1), 7: ("conflict", 1), 8: ("replay", 5), 9: ("fresh", 9), 10: ("conflict", 1),
        11: ("fresh", 11), 12: ("conflict", 11), 13: ("replay", 11),
    }
    assert len(found) == 13


def test_first_only(run):
    found = run(requests.first_only, asked((1, "a", "PUT", "/x", 0), (2, "b", "PUT", "/x", 0)), asked((3, "a", "PUT", "/x", 3), (4, "c", "GET", "/", 60)), asked((5, "d", "PUT", "/x", 61), (6, "a", "PUT", "/x", 61)))
    assert sorted(r["id"] for r in found) == [1, 2, 4, 5, 6]


def test_unsettled_files(spark):
    row = "root_id int, rel_path string, size bigint, mtime_ms bigint, run bigint"
    before = spark.createDataFrame([(1, "a", 1, 10, 1), (1, "b", 1, 10, 1), (1, "c/d", 1, 10, 1), (1, "cd", 1, 10, 1), (2, "c/d", 1, 10, 1), (1, "e", 1, 10, 1), (1, "f", 1, 10, 1)], row)
    seen = spark.createDataFrame([(1, "a", 1, 10, 2), (1, "b", 2, 9_000, 2), (1, "e", 2, 9_000, 2), (1, "f", 3, 4_000, 2), (1, "g", 1, 9_999, 2), (1, "h", 1, 99_999, 2)], row)
    again = spark.createDataFrame([(1, "b", 2, 9_000, 2), (1, "e", 3, 9_500, 2), (1, "h", 1, 99_999, 2)], row)
    closed = spark.createDataFrame([(1, "c")], "root_id int, rel_path string")
    moving = changes.moving(seen, again, 10_000)
    assert {r["rel_path"] for r in moving.collect()} == {"e", "g"} and changes.moving(seen, again, 10_000, 0).count() == 0
    got = {(r["root_id"], r["rel_path"]): (r["state"], r["size"], r["run"]) for r in changes.feed(before, seen, moving, closed).collect()}
    assert got == {
        (1, "a"): ("same", 1, 2), (1, "b"): ("changed", 2, 2), (1, "e"): ("held", 1, 1), (1, "f"): ("changed", 3, 2), (1, "g"): ("held", None, None), (1, "h"): ("added", 1, 2),
        (1, "c/d"): ("closed", 1, 2), (2, "c/d"): ("vanished", None, None), (1, "cd"): ("vanished", None, None),
    }
    assert changes.after(changes.feed(before, seen, moving, closed)).count() == 6


def test_swept_trees_of_two_roots(spark):
    rows = spark.createDataFrame([(1, "a/x"), (2, "a/x"), (1, "b")], "root_id int, rel_path string")
    seen = rows.filter("root_id = 1 AND rel_path = 'a/x'")
    none = spark.createDataFrame([], "root_id int, folder string")
    assert [tuple(r) for r in keyed.swept_trees(rows, seen, none, ["root_id"]).collect()] == [(1, "a/x")]
    kept = spark.createDataFrame([(2, "a")], "root_id int, folder string")
    assert sorted(tuple(r) for r in keyed.swept_trees(rows, seen, kept, ["root_id"]).collect()) == [(1, "a/x"), (2, "a/x")]
