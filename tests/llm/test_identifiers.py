"""Identifiers beyond 2**53 beside nulls, extra columns of clashing names, repeated rows, and a benchmark in several parts: values, not only counts."""

import pytest

from shelfmark.llm import decontamination, language, mixing, pii, quality, secret_scan

BIG = 1 << 60
SCHEMA = "doc_id bigint, text string, lang string, source string, _key int, _range string, _row string, near boolean, block int, _spans int"
TEXTS = ["the house by the sea and the old garden of the town", "password=abcdefgh12345678 for Mr John Smith", "der Hund und die Katze in dem alten Haus", None, "", "the house by the sea and the old garden of the town"]
IDS = [BIG + 1, BIG + 3, None, BIG + 5, BIG + 7, BIG + 1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "en", "de", None, "en", "en")[n], "s", n, "x", "y", True, n, n) for n, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the old garden"), (2, "in dem alten haus"), (3, None)], "item_id bigint, text string")


APPLIED = {
    "language": lambda d, b: language.identify(d), "quality": lambda d, b: quality.score(d), "decontamination": decontamination.find,
    "pii": lambda d, b: pii.replace(d), "secrets": lambda d, b: secret_scan.scan(d), "mixing": lambda d, b: mixing.mix(d),
}


@pytest.mark.parametrize("name", APPLIED)
def test_identifiers_stay(docs, items, name):
    assert sorted((r["doc_id"] for r in APPLIED[name](docs, items).collect()), key=str) == sorted(IDS, key=str)


def test_whole_rows_pass(docs, items):
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    every = of(docs)
    assert of(decontamination.decontaminate(docs, items)) == [r for r in every if "garden" not in (r[1] or "") and "Haus" not in (r[1] or "")]
    assert [r for r in of(secret_scan.redact(docs)) if r[0] != BIG + 3] == [r for r in every if r[0] != BIG + 3]
    assert {r[0] for r in of(language.keep_identified(docs))} <= set(IDS)


@pytest.mark.parametrize("part_bytes", [1 << 20, 10])
def test_benchmark_in_parts(docs, items, monkeypatch, part_bytes):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    got = sorted(((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["spans"]) for r in decontamination.find(docs, items).collect()))
    want = [(str(BIG + 1), 12, 3, 1, "6:9")] * 2 + [(str(BIG + 3), 6, 0, 0, ""), (str(BIG + 5), 0, 0, 0, ""), (str(BIG + 7), 0, 0, 0, ""), ("None", 9, 4, 1, "5:9")]
    assert got == sorted(want)
    cut = {r["_key"]: r["text"] for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert cut[0] == "the house by the sea and  of the town" and cut[2] == "der Hund und die Katze "
    assert decontamination.decontaminate(docs, items, remove="spans").columns == docs.columns
