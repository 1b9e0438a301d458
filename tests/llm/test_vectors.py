"""Vector operators against plain Python, with odd rows, ties, repeated rows and clashing columns."""

import hashlib
import math
import random

import pytest

from shelfmark.llm import codebooks, hard_negatives


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Told again with lists: rows of (vec_id, vector, label) -> sorted rows."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = -(-max(len(v) for _, v, _ in kept) // parts)
    ints = [[math.floor(1024 * x) for x in v] + [0] * (parts * d - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))
    books = [[ints[r][p * d : p * d + d] for r in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in ints:
                x = v[p * d : p * d + d]
                of.setdefault(near(x, books[p])[1], []).append(x)
            for e, xs in of.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], {}
    for (i, _, y), v in zip(kept, ints, strict=True):
        found = [near(v[p * d : p * d + d], books[p]) for p in range(parts)]
        error = sum(f for f, _ in found)
        total[y] = total.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, y))
    return sorted((str(i), c, e, total[y], sha) for i, c, e, y in out)


SCHEMA = "vec_id bigint, embedding array<double>, label int"


def told(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_codes_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, [rng.choice([-1.0, -0.5, 0.25, 0.37, rng.random()]) for _ in range(8)], rng.choice([None, 1, 2, 3])) for i in range(400)]
    rows += [rows[5]] * 150 + [(7, None, 1), (8, [0.5] * 7 + [None], 1), (9, [float("nan")] * 8, 1), (10, [float("-inf")] * 8, None), (None, [0.1] * 8, 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = df.selectExpr("*", "1 as part", "2 as entry", "'x' as code", "0 as error", "4 as _id", "5 as _n")
    assert told(codebooks.compress(clash)) == plain_codes(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, 1), (2, [None], 1)],
    [(1, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.3, 0.2, 0.3, 0.4], None)],
    [(1, [], 1), (2, [0.5] * 3, 1), (3, [0.25] * 6, None)],
])
def test_codes_of_few_rows(spark, rows):
    got = codebooks.compress(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and told(got) == plain_codes(rows)


def test_huge_components_stay_in_range(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0, 2.0, 3.0], 1) for i in range(4)] + [(9, [0.0] * 4, 1)]
    got = codebooks.compress(spark.createDataFrame(rows, SCHEMA), entries=2, rounds=2).collect()
    assert len(got) == 5 and all(r["error"] >= 0 and r["label_error"] >= r["error"] for r in got)


def test_cold_labels_meet_by_key(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "HOT", 3)
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)], rng.choice([None, None, 1, 1, *range(20)])) for i in range(300)]
    assert told(codebooks.compress(spark.createDataFrame(rows, SCHEMA), entries=8)) == plain_codes(rows, entries=8)


def plain_negatives(rows, every=50, positives=5, negatives=3):
    """Told again with lists: rows of (vec_id, vector, label) -> sorted rows."""
    kept = [(i, v, y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    out = []
    for a, (i, _, y) in enumerate(kept):
        if i is None or i % every:
            continue
        met = [(-sum(p * q for p, q in zip(ints[a], ints[b], strict=False)), kept[b][0] is None, kept[b][0] or 0, kept[b][2] == y) for b in range(len(kept)) if b != a]
        for ps, pnull, pid, _ in sorted(m for m in met if m[3])[:positives]:
            fit = sorted(m for m in met if not m[3] and 50 * -ps <= 100 * -m[0] <= 95 * -ps)[:negatives]
            out += [(i, None if pnull else pid, r, None if null else n, -ps, -s) for r, (s, null, n, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=str)


@pytest.mark.parametrize("block, gather", [(4096, 64), (5, 2)])
def test_negatives_against_plain_python(spark, monkeypatch, block, gather):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GATHER", gather)
    rng = random.Random(3)
    rows = [(i * 5 - 300, [rng.gauss(0.3, 0.5) for _ in range(6)], rng.choice([None, 1, 2, 3])) for i in range(200)]
    rows += [(50, rows[5][1], 1)] * 3 + [(5000 + 3 * i, rows[7][1], 2) for i in range(200)] + [rows[9]] * 150
    rows += [(100, None, 1), (150, [0.5] * 5 + [None], 1), (200, [float("nan")] * 6, 1), (None, rows[7][1], 2), (None, rows[3][1], 1), (250, [0.0] * 6, 1), (300, [0.1] * 4, 2), (350, [1e3, -1e3] * 3, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_negatives(rows)
    assert len(want) > 100 and found(hard_negatives.mine(df.selectExpr("*", "1 as w", "2 as _id", "3 as score", "4 as _block"))) == want


@pytest.mark.parametrize("rows", [
    [],
    [(1, [0.5], 1)],
    [(50, [], 1), (51, [0.5], 1), (52, [0.25], 2)],
    [(0, [0.5], 1), (0, [0.5], 1), (3, [0.25], 2), (3, [0.25], 2), (4, None, 2), (50, [0.5], None)],
])
def test_negatives_of_few_rows(spark, rows):
    assert found(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA))) == plain_negatives(rows)


def test_negatives_with_labels_of_text_and_huge_components(spark):
    rows = [(i, [3e38 * (i % 3 - 1), 1.0 + i], "ab"[i % 2]) for i in range(0, 300, 10)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string"))
    assert {r["anchor_id"] for r in got.collect()} <= {0, 50, 100, 150, 200, 250}
    rows = [(i, v[1:], y) for i, v, y in rows]
    assert found(hard_negatives.mine(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string"))) == plain_negatives(rows)
