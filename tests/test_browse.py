from pyspark.sql import functions as F

from shelfmark.plans import browse


def test_ordinals_are_unique(spark):
    cases = {(1, 1, 1): [1, 2, 3], (2, 1, 1): [2, 1, 3], (1, 3, 1, 3): [1, 3, 4, 5], (1, None, 2): [1, 2, 3], (): [], (7,): [7], (3, 3, 2): [3, 2, 4]}
    rows = spark.createDataFrame([(list(k),) for k in cases], "o array<int>").select("o", browse.unique_ordinals(F.col("o")).alias("u")).collect()
    assert {tuple(r.o): r.u for r in rows} == {k: v for k, v in cases.items()}


def test_seat_is_exact_or_next_or_last(spark):
    rows = spark.createDataFrame([(1, 0), (1, 4), (2, 1), (2, 2), (3, 9)], "q int, p int")
    wanted = F.when(F.col("q") == 3, 9).otherwise(3)
    assert {r.q: r.current for r in browse.seats(rows, wanted, ["q"], "p").collect()} == {1: 4, 2: 2, 3: 9}


def test_folders_are_no_child_of_themselves_and_hidden_ones_go(spark):
    folders = spark.createDataFrame([(1, "", ""), (1, "a", ""), (1, "b", ""), (1, "a/c", "a"), (2, "a", "")], "root_id int, rel_path string, parent_rel_path string")
    albums = spark.createDataFrame([(1, "b", "rule"), (2, "a", "rule"), (1, "a", None)], "root_id int, rel_path string, junk_reason string")
    parents = spark.createDataFrame([(1, ""), (2, "")], "root_id int, parent_rel_path string")
    assert [(r.root_id, r.rel_path) for r in browse.child_folders(folders, albums, parents).collect()] == [(1, "a")]


def test_only_the_last_run_of_a_root_counts(spark):
    ledger = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 2), (4, 2, None)], "id int, root_id int, last_seen_run_id int")
    assert sorted(r.id for r in browse.current(ledger).collect()) == [2, 3]
