"""The kept index against a scan, after changes against one built anew, and which buckets are read."""

import random

import pytest

from shelfmark.operators import search
from shelfmark.operators.search_index import SearchIndex


def rows(spark, some):
    return spark.createDataFrame(some, "id bigint, a string, b string")


def same(index, df, words):
    want = {r["id"]: round(r["rank"], 9) for r in search.ranked(df, ["a", "b"], words).collect()}
    assert {r["key"]: round(r["rank"], 9) for r in index.search(words).collect()} == want
    return want


def test_changes_against_an_index_built_anew(spark, tmp_path):
    rng = random.Random(11)
    words = ["blue", "blues", "train", "trail", "été", "Ann", "x", "the", "théâtre", "1999"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    all_ = {i: (i, text(), rng.choice([None, text()])) for i in range(60)}
    index = SearchIndex(spark, f"{tmp_path}/a", buckets=8)
    index.update(rows(spark, list(all_.values())), "id", ["a", "b"], 0)
    for ask in (["blue"], ["train", "bl"], ["the", "t"], ["blue", "blue"], ["nothing"]):
        same(index, rows(spark, list(all_.values())), ask)
    for i in [*range(5), 100, 101]:
        all_[i] = (i, text() + " new", None)
    for i in (10, 11):
        del all_[i]
    changed = rows(spark, [all_[i] for i in [*range(5), 100, 101]])
    for _ in range(2):  # a change that is repeated changes nothing more
        index.update(changed, "id", ["a", "b"], 1, gone=rows(spark, [(10, None, None), (11, None, None), (999, None, None)]))
        for ask in (["blue"], ["train", "bl"], ["new"], ["ete"]):
            same(index, rows(spark, list(all_.values())), ask)
    assert index.totals.read().first()["rows"] == len(all_)


def test_only_the_asked_buckets_are_read(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/a", buckets=16)
    index.update(rows(spark, [(i, f"w{i} q{i}", None) for i in range(50)] + [(99, "zebra stripes", "zebra")]), "id", ["a", "b"], 0)
    read = {f.split("bucket=")[1].split("/")[0] for f in index.read_for(["zebra", "strip"]).inputFiles()}
    assert 1 <= len(read) <= 2 < len(index.postings.versions())
    assert [r["key"] for r in index.search(["zebra", "strip"]).collect()] == [99]
    before = dict(index.postings.versions())
    index.update(rows(spark, [(99, "zebra", "stripe")]), "id", ["a", "b"], 1)
    assert sum(after != before[b] for b, after in index.postings.versions().items()) <= 2


def test_nothing(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/a", buckets=4)
    index.update(rows(spark, []), "id", ["a", "b"], 0)
    assert index.search(["a"]).count() == 0 and index.search([]).count() == 0
    index.update(rows(spark, [(1, None, None), (2, "", "word")]), "id", ["a", "b"], 1)
    assert [r["key"] for r in index.search(["word"]).collect()] == [2] and index.totals.read().first()["rows"] == 2
    index.update(rows(spark, []), "id", ["a", "b"], 2, gone=rows(spark, [(2, None, None)]))
    assert index.search(["word"]).count() == 0


@pytest.mark.parametrize("words", [["the", "and"], ["and", "the", "t"], ["a"], ["the", "the"]])
def test_hits_of_a_scan_against_postings(spark, words):
    df = spark.createDataFrame([(1, "The and AND then"), (2, "the"), (3, "and the t an a"), (4, None), (5, "andy the")], "id int, text string")
    want = {tuple(r) for r in search.ask(search.postings(df, "id", "text"), "id", words).collect()}
    assert {tuple(r) for r in search.hits(df, "id", "text", words).collect()} == want
