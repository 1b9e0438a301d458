"""Roles, releases, discs and virtual nodes on small trees, and the kernels they stand on."""

import os
import random
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import expressions as X
from shelfmark.operators import classify, nodes


def tree(spark, paths, root=1):
    rows = [(root, p.rpartition("/")[0], p.rpartition("/")[2]) for p in paths]
    files = spark.createDataFrame(rows, "root_id int, folder string, name string")
    return files.withColumn("kind", X.file_kind("name")).cache()


def told(df, *columns):
    return {tuple(r[c] for c in columns[:-1]) if len(columns) > 2 else r[columns[0]]: r[columns[-1]] for r in df.collect()}


CASES = {
    "A/CD1/x.flac A/CD2/y.flac A/art/z.jpg": {"A": "box", "A/CD1": "disc", "A/CD2": "disc", "A/art": "empty", "": "category"},
    "A/CD1/x.flac A/CD2/log.txt": {"A": "category", "A/CD1": "album", "A/CD2": "empty"},
    "A/CD1/x.flac A/CD2/y.flac A/other/z.flac": {"A": "category", "A/CD1": "album", "A/CD2": "album", "A/other": "album"},
    "A/CD1/in/x.flac A/CD2/in/y.flac": {"A": "category", "A/CD1": "category", "A/CD1/in": "album"},
    "Box Set/one/x.mp3 Box Set/two/y.mp3": {"Box Set": "box", "Box Set/one": "disc", "Box Set/two": "disc"},
    "set/one/x.mp3": {"set": "category", "set/one": "album"},
    "Hits (3CD)/a/x.ogg Hits (3CD)/b/x.ogg Hits (3CD)/c/x.ogg": {"Hits (3CD)": "box", "Hits (3CD)/a": "disc"},
    "Hits (3CD)/a/x.ogg Hits (3CD)/b/x.ogg": {"Hits (3CD)": "category", "Hits (3CD)/a": "album"},
    "Hits XY3CD/a/x.ogg Hits XY3CD/b/x.ogg Hits XY3CD/c/x.ogg": {"Hits XY3CD": "category"},
    "A/p.cue A/p.flac A/q.CUE A/q.flac.cue A/q.FLAC A/sub/x.mp3": {"A": "album", "A/sub": "album"},
    "A/p.cue A/p.flac A/q.CUE A/q.FLAC A/sub/x.mp3": {"A": "box", "A/sub": "album"},
    "A/d1/x.wav A/d2/y.wav": {"A": "box", "A/d1": "disc"},
    "x.mp3": {"": "album"},
}


def test_roles(spark):
    cases = [[p.strip() for p in re.findall(r"\S.*?\.[a-zA-Z0-9.]+(?=\s|$)", paths)] for paths in CASES]
    every = reduce(DataFrame.union, [tree(spark, files, i) for i, files in enumerate(cases)])
    got = told(classify.roles(every), "root_id", "rel_path", "role")
    for i, (files, want) in enumerate(zip(cases, CASES.values(), strict=True)):
        assert {k: got[i, k] for k in want} == want, files
        assert {p for r, p in got if r == i} == {""} | {"/".join(p.split("/")[:k]) for p in files for k in range(1, len(p.split("/")))}


def test_roles_of_two_roots_stay_apart(spark):
    both = tree(spark, ["A/CD1/x.flac"]).union(tree(spark, ["A/CD2/x.flac"], 2))
    assert set(told(classify.roles(both), "root_id", "rel_path", "role").values()) == {"category", "album"}
    assert classify.roles(both.limit(0)).count() == 0


def test_albums_and_releases(spark):
    files = tree(spark, [
        "A/CD 2/x.flac", "A/CD 1/x.flac", "A/CD 1/bonus/y.flac", "Box/one/x.mp3", "Box/two/y.mp3", "S/T - CD 1 [a]/x.wav", "S/T - CD 2 [b]/x.wav", "S/other/x.wav",
        "W/A CD 1/x.wav", "W/A CD 2/x.wav", "W/B CD 1/x.wav", "W/B CD 2/x.wav", "W/c/x.wav", "F/Wall [Disc 2].cue", "F/Wall [Disc 2].ape", "F/Wall [Disc 1].cue", "F/Wall [Disc 1].ape", "F/extra.mp3",
        "G/01 - Pulse.cue", "G/01 - Pulse.wav", "G/2 - Pull.cue", "G/2 - Pull.wav",
    ])
    t = classify.roles(files).cache()
    got = {r["rel_path"]: (r["release_path"], r["disc_number"]) for r in classify.albums(files, t).collect()}
    assert got == {
        "A/CD 1": ("A", 1), "A/CD 2": ("A", 2), "A/CD 1/bonus": ("A", None), "Box/one": ("Box", 1), "Box/two": ("Box", 2), "S/T - CD 1 [a]": ("S", 1), "S/T - CD 2 [b]": ("S", 2), "S/other": (None, None),
        "W/A CD 1": (None, None), "W/A CD 2": (None, None), "W/B CD 1": (None, None), "W/B CD 2": (None, None), "W/c": (None, None),
        "F/Wall [Disc 1].ape": ("F", 1), "F/Wall [Disc 2].ape": ("F", 2), "F": (None, None), "G/01 - Pulse.wav": ("G", 1), "G/2 - Pull.wav": ("G", 2),
    }
    assert {r["rel_path"] for r in classify.releases(t).collect()} == {"A", "Box", "S", "F", "G"}
    titles = told(classify.flat_discs(files, t), "name", "title")
    assert titles == {"Wall [Disc 1].ape": "Wall [Disc 1]", "Wall [Disc 2].ape": "Wall [Disc 2]", "01 - Pulse.wav": "se", "2 - Pull.wav": "l"} | {k: v for k, v in titles.items() if k.startswith("0") or k.startswith("2")}


def test_longest_common_prefix_against_the_standard_library(spark):
    rng, rows = random.Random(8), []
    for g in range(60):
        head = "".join(rng.choice("aé b") for _ in range(rng.randrange(6)))
        rows += [(g, head + "".join(rng.choice("ab") for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(1, 5))]
    df = spark.createDataFrame([*rows, (99, None)], "g int, s string")
    got = told(df.groupBy("g").agg(classify.longest_common_prefix("s").alias("p")), "g", "p")
    assert got == {g: os.path.commonprefix([s for h, s in rows if h == g]) for g in range(60)} | {99: None}


def test_disc_and_natural_kernels(spark):
    names = {
        "CD 2": (2, None), "d2": (2, None), "Disc.1": (1, None), "Name (Disk 3)": (3, None), "disc-12": (12, None), "CD123": (None, None), "CDs 2": (None, None), "Live cd 1 2": (None, None), "The Box 3CD": (None, 3),
        "Songs [2 cd] 1999": (None, 2), "Name CD04 extra": (4, None), "acd 2": (None, None), "d 2 x": (None, None), "Best 10CDs": (None, None), "disk_7": (7, None), "": (None, None), "2cd CD 1": (1, 2), "ACD12CD": (None, None),
    }
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    got = {r["n"]: (r["a"], r["b"]) for r in df.select("n", X.disc_number("n").alias("a"), X.stated_discs("n").alias("b")).collect()}
    assert got == {**names, None: (None, None)}
    sites = {"my-files.ru": True, "shop.example.co.uk": True, "Lost.And.Found": False, "Vol. 2": False, "http://site.com": False, "a.b": False, "name": False, "x-.com": False, " site.travel ": True, "site.toolongs": False, "a..com": False}
    df = spark.createDataFrame([(n,) for n in sites], "n string")
    assert told(df.select("n", X.site_like("n").alias("x")), "n", "x") == sites
    long = ["a" + "1" * 22, "a" + "1" * 21 + "2", "a" + "2" * 21, "a9", "a10", "a010b", "Ä1", "a1"]
    df = spark.createDataFrame([(n,) for n in long], "n string")
    assert df.select(X.natural_key("n").alias("k")).distinct().count() == len(long) - 1  # only accents and case fold
    assert [r["n"] for r in df.filter("n <> 'Ä1'").orderBy(X.natural_key("n")).collect()] == ["a1", "a9", "a10", "a010b", "a" + "2" * 21, "a" + "1" * 22, "a" + "1" * 21 + "2"]


def test_nodes_gather_folders_of_one_artist_over_roots(spark):
    files = tree(spark, ["Big Band/1990 - A/x.mp3", "big band live/b/x.mp3", "Bigger/c/x.mp3", "The Big/d/x.mp3", "Scans/x.jpg", "loose.mp3"]).union(tree(spark, ["BIG BAND!/A/e/x.mp3", "Junk/x.log"], 2))
    t = classify.roles(files).cache()
    a = classify.albums(files, t)
    records = a.select("root_id", F.coalesce("release_path", "rel_path").alias("rel_path")).distinct()
    artists = spark.createDataFrame([("big band", 1, "Big Band", None), ("big", 2, "Big", "Big, The"), ("nobody", 3, "Nobody", None)], "key string, id int, name string, sort_key string")
    got = {r["node"]: (r["artist_id"], r["name"], r["sort"], r["folders"], r["records"]) for r in nodes.virtual_nodes(t, records, artists).collect()}
    assert got == {"big band": (1, "Big Band", "Big Band", 3, 3), "/1/Bigger": (None, "Bigger", "Bigger", 1, 1), "big": (2, "Big", "Big, The", 1, 1)}
    inside = told(nodes.nested(t, records, artists), "root_id", "rel_path", "records")
    assert inside[2, "BIG BAND!/A"] == 1 and inside[1, "Big Band/1990 - A"] == 1 and (2, "Junk") not in inside


FOLDERS = {
    "1987 - Ann & Bob + Carl - Halves (Cass, C60)": (1987, "Ann & Bob + Carl", "Halves", "Cass, C60"), "Some Group - Tunes - 1985 (7CD FLAC)": (1985, "Some Group", "Tunes", "7CD FLAC"), "1995 - Sum (1234-5)": (1995, None, "Sum (1234-5)", None),
    "2003 - Short - ep": (2003, None, "Short", None), "2012 - Light - CD 1 [XX-1]": (2012, None, "Light", "XX-1"), "Shelf - 2015 - Name - More (one two)": (2015, None, "Name - More (one two)", None), "xxxx - Hidden (Tape, Cass)": (None, None, "Hidden", "Tape, Cass"),
    "Only a Name - With One Dash": (None, None, "Only a Name - With One Dash", None), "Me_-_My-Tune-2010-Us": (2010, "Me", "My-Tune", None), "Me_-_Tune": (None, "Me", "Tune", None), "1998 - In (Live - Tape)": (1998, None, "In (Live - Tape)", None),
    "1991. Dots": (1991, None, "Dots", None), "1991 ● Dots": (1991, None, "Dots", None), "Ann feat. Bob": (None, "Ann feat. Bob", None, None), "Years 2020/1980": (None, None, "Years 2020/1980", None), "1999": (None, None, "1999", None), "a -b- c": (None, None, "a -b- c", None),
    "2000 - X (2 CD)": (2000, None, "X", "2 CD"), "2000 - X (BLU-RAY)": (2000, None, "X", "BLU-RAY"), "2000 - X (c60)": (2000, None, "X", "c60"), "2000 - X (100)": (2000, None, "X (100)", None), "Me_-_1999-2001": (2001, "Me", "1999", None),
}
FILES = {
    ("01 - Group - Song.flac", "Group - Album"): "Song", ("07.Name.mp3", None): "Name", ("05-me_-_the_tune-mysite.com.ogg", "Me Mysite.com"): "the tune", ("12.wav", "x"): "12", ("A - B.ape", "a b"): "B", ("003 - Long.mp3", None): "003 - Long",
    ("02) Tune.mp3", None): "Tune", ("9 -.mp3", None): "9 -", ("Me - Me - Tune - Me.mp3", "me"): "Tune - Me",
}


def test_names_of_folders_and_files(spark):
    from shelfmark.functions import folders

    rows = folders.folder_names(spark.createDataFrame([(n,) for n in FOLDERS], "n string"), "n").collect()
    assert {r["n"]: tuple(r["said"]) for r in rows} == FOLDERS
    files = spark.createDataFrame([(a, b) for a, b in FILES], "n string, a string")
    assert {(r["n"], r["a"]): r["t"] for r in files.select("n", "a", folders.file_title("n", "a").alias("t")).collect()} == FILES
