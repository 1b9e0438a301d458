"""The n-gram Jaccard join against brute force: hot lists in small tiles, large identifiers, and which row of a group stays."""

import random

import pytest

from shelfmark.llm import jaccard_join

BIG = 1 << 60
SCHEMA = "doc_id bigint, text string, source string, row string, it string"


def sets(text, k):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_force(rows, k, percent):
    """Smallest doc_id reachable by links, by row."""
    found, label = [sets(r[1], k) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if found[i] and found[j] and 100 * both >= percent * len(found[i] | found[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    of = lambda i: [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
    return [min(of(i), default=None) for i in range(len(rows))]


def near_copies(seed, bases, copies, edits, shared=0):
    """Copies of ``bases`` texts with up to ``edits`` words changed; all texts hold one passage of ``shared`` words."""
    rng, out = random.Random(seed), []
    passage = [f"common{i}" for i in range(shared)]
    for _ in range(bases):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(passage + words))
    return out


@pytest.mark.parametrize(("tile", "shared"), [(4, 0), (4, 200), (256, 60)])
def test_links_agree_with_brute_force(spark, monkeypatch, tile, shared):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SHORT", tile)
    texts = near_copies(tile + shared, 6, 12, 4, shared) + ["", None, "one", "one", "one two"]
    rows = [(BIG + 7 * i % 101, t, "s", "r", "i") for i, t in enumerate(texts)]
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    want = [(r[0], len(sets(r[1], 4)), c) for r, c in zip(rows, brute_force(rows, 4, 85), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_large_identifiers_beside_nulls(spark):
    texts = near_copies(3, 2, 2, 0)
    rows = [(BIG + 1, texts[0], "s", "r", "i"), (BIG + 3, texts[2], "s", "r", "i"), (None, texts[0], "s", "r", "i"), (BIG + 5, texts[1], "s", "r", "i")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(BIG + 1, BIG + 1), (BIG + 3, BIG + 3), (None, BIG + 1), (BIG + 5, BIG + 1)}


T, U = "a tale of one town and its many wide roads to the sea", "quite another story of ships and birds over a grey stone wall"


@pytest.mark.parametrize(
    ("rows", "stay"),
    [
        ([(1, T), (7, T), (7, U)], [(1, T), (7, U)]),
        ([(7, T), (7, T), (8, U)], [(7, T), (8, U)]),
        ([(None, T), (BIG + 3, T), (BIG + 1, T), (None, U), (None, U)], [(BIG + 1, T), (None, U)]),
        ([(5, T), (5, T), (5, T.upper()), (6, T)], 1),
        ([(1, None), (1, None), (2, ""), (2, " ")], [(1, None), (1, None), (2, ""), (2, " ")]),
    ],
)
def test_one_row_of_each_group_stays(spark, rows, stay):
    docs = spark.createDataFrame([(*r, "s", "r", "i") for r in rows], SCHEMA)
    kept = jaccard_join.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(got) == stay if isinstance(stay, int) else got == sorted(stay, key=str)


@pytest.mark.parametrize("full", [False, True])
def test_rows_without_copies_pass_where_they_are_read(spark, monkeypatch, full):
    """What the bitmap does not mark meets nothing but the bitmap, however large the table; one that marks all changes no result."""
    if full:
        monkeypatch.setattr(jaccard_join, "_marks", lambda _: spark.range(1 << jaccard_join.BITMAP_BITS - 6).selectExpr("id as word", "-1L as bits"))
    docs = spark.createDataFrame([(r, t, "s", "r", "i") for r, t in [(2, T), (3, T), (4, U), (4, U), (5, None), (6, "alone")]], SCHEMA)
    kept = jaccard_join.keep_one_of_each(docs, 5, 80)
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    assert all("strategy=broadcast" in x for x in plan.children().apply(0).toString().split("\n") if "Join" in x)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, T), (4, U), (5, None), (6, "alone")]
