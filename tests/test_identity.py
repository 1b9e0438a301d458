"""Credits, homonyms and names in two alphabets; groups of links against a plain search."""

import random

from shelfmark.functions.expressions import marks_in
from shelfmark.operators import graph, identity


def test_latin_spellings(spark):
    want = {"кино": ["kino"], "хоц": ["khots", "hoc"], "щука 7": ["shchuka 7", "shuka 7"], "kino": [], "": [], "я kino": ["ya kino", "a kino"], "Їжак": ["izhak"], "ԑ": ["ԑ"]}
    df = spark.createDataFrame([(k,) for k in want], "k string")
    assert {r["k"]: list(r["s"]) for r in df.select("k", identity.latin_spellings("k").alias("s")).collect()} == want


def test_names_in_two_alphabets_are_grouped(spark):
    keys = ["кино", "кіно", "kino", "хоц", "hoc", "khots", "alone", "kino#2", "кино#2", "я"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {tuple(r) for r in identity.twins(df).collect()} == {("кино", "kino"), ("кіно", "kino"), ("хоц", "hoc"), ("хоц", "khots")}
    groups = {r["key"]: r["group"] for r in identity.alphabets(df).collect()}
    assert groups == {k: "kino" for k in ("kino", "кино", "кіно")} | {k: "hoc" for k in ("hoc", "khots", "хоц")}


def test_groups_against_a_plain_search(spark):
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            more = near[todo.pop()] - seen
            seen |= more
            todo += more
        want[n] = min(seen)
    assert {r["node"]: r["group"] for r in graph.groups(spark.createDataFrame(links, "a bigint, b bigint")).collect()} == want
    assert graph.groups(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_credits_of_tags(spark):
    rows = [
        (1, "albumartist", "X", 1), (1, "albumartist", "Y", 0), (1, "artist", "Z", 0), (2, "artist", "Solo & Co", 0), (2, "artist", "Solo & Co", 1), (3, "artist", "A & B", 0), (3, "artist", "B feat. C", 1),
        (4, "artist", "A & B", 0), (4, "artist", "B & A", 1), (5, "artist", "A", 0), (5, "artist", "B", 1), (6, "title", "t", 0),
    ]
    got = identity.credit_of_tags(spark.createDataFrame(rows, "album_id int, name string, value string, place int"))
    assert {tuple(r) for r in got.collect()} == {(1, "Y"), (2, "Solo & Co"), (3, "B")}


def test_precedence_homonyms_and_the_name_shown(spark):
    evidence = [
        (1, "tag", 0, "Bjork"), (1, "cue", 1, " "), (1, "folder", 0, "Björk"), (2, "cue", 0, "bjork"), (2, "tag", 0, "x"), (3, "tag", 0, "Bjork"), (4, "tag", 0, "BJORK (UK)"), (5, "tag", 0, "Other & Bjork"), (6, "other", 0, "nobody"), (7, "tag", 0, "The"), (8, "cue", 0, None),
    ]
    credits = identity.chosen(spark.createDataFrame(evidence, "album_id int, source string, place int, text string"))
    assert {(r["album_id"], r["source"]) for r in credits.collect()} == {(1, "folder"), (2, "cue"), (3, "tag"), (4, "tag"), (5, "tag"), (7, "tag")}
    places = [(1, "/r", "Bjork/a"), (2, "/r", "x/Björk/b/c"), (3, "/r", "loose"), (4, "/s\\Bjork", "d"), (5, "/r", ""), (7, "/r", "The/a"), (9, "/r", "Bjork")]
    artists, entries = identity.artists_and_credits(credits, spark.createDataFrame(places, "album_id int, root_path string, rel_path string"))
    got = {r["key"]: (r["name"], r["ambiguous"], r["homonym"], r["albums"]) for r in artists.collect()}
    assert got == {"bjork": ("Björk", True, True, 3), "bjork#2": ("bjork", True, True, 1), "bjork#3": ("BJORK (UK)", True, True, 1), "other": ("Other", False, False, 1)}
    assert {(r["album_id"], r["position"], r["key"]) for r in entries.collect()} == {(1, 0, "bjork"), (2, 0, "bjork#2"), (3, 0, "bjork"), (4, 0, "bjork#3"), (5, 0, "other"), (5, 1, "bjork")}


def test_marks(spark):
    names = {"Björk": 1, "Björk": 1, "Ǖ": 1, "plain": 0, "й": 1}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["m"] for r in df.select("n", marks_in("n").alias("m")).collect()} == names
