"""Odd rows, empty tables and brute-force counterparts for the numbered operators."""

import hashlib
import re

import pytest

import __spark_entry__
from shelfmark.llm import decontamination, fingerprints, html_text, jaccard_join, language, mixing, pii, quality, secret_scan, warc
from tests.compare import same
from tests.conftest import SF

PROSE = " ".join(f"word{i % 37} tale{i % 11}" for i in range(60))
ROWS = [(1, PROSE, "en", "a", "x"), (2, PROSE, "en", "a", "x"), (2, PROSE, "en", "a", "x"), (3, None, None, None, None), (4, "", "de", "b", "y"), (None, "password=abcdefgh12345678 Mr Smith", None, None, "z"), (5, "ein kurzer Satz " * 3000, "de", "b", None)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word0 tale0"), (2, None), (3, "")], "item_id bigint, text string")


APPLIED = {
    "join": lambda d, b: jaccard_join.join(d), "fingerprints": lambda d, b: fingerprints.fingerprint(d), "language": lambda d, b: language.identify(d), "quality": lambda d, b: quality.score(d),
    "decontamination": decontamination.find, "pii": lambda d, b: pii.replace(d), "secrets": lambda d, b: secret_scan.scan(d), "mixing": lambda d, b: mixing.mix(d),
}


@pytest.mark.parametrize("name", APPLIED)
def test_odd_rows_and_empty_table(spark, odd, items, name):
    out = APPLIED[name](odd, items).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert APPLIED[name](spark.createDataFrame([], SCHEMA), items).count() == 0


def test_odd_pages(spark):
    rows = [(1, "http://a/x", "<p>One</p>", "q"), (2, None, None, "q"), (2, None, None, "q"), (3, "http://a/y z", "<article><p>Tom &amp; Co</p></article><nav>menu</nav>", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, kind string")
    text = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert text == {1: "One", 2: "", 3: "Tom & Co"}
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert kinds == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None)]
    assert html_text.extract(pages.limit(0)).count() == warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op4_warc", "op7_decontamination", "op10_mixing", "op11_vector_codes", "op13_hard_negatives"])
def test_query_agrees_with_sql(spark, duck, name):
    same(__spark_entry__.queries()[name](spark, SF), duck, __spark_entry__.oracle_sql()[name])


def test_loser_tree():
    runs = [[1, 4, 4, 9], [], [2, 4], [0], [3, 10]]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_parity_never_overstates(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m, both in ((50, 60, 40), (300, 350, 20), (5, 900, 5), (1000, 1100, 990)):
        t = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        assert jaccard_join.apart(jaccard_join.parity(t[:n]), jaccard_join.parity(t[n - both :])) <= n + m - 2 * both


def test_fingerprints_against_plain_python(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in __spark_entry__.queries()["op2_fingerprints"](spark, SF).collect():
        t, nxt = docs[r["doc_id"]], docs[after[r["doc_id"]]]
        k = len(t) // 3
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()


def test_held_out_languages(spark):
    said = language.identify(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = said.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)


def test_secrets_against_plain_python(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assign = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
    for r in __spark_entry__.queries()["op9_secret_scan"](spark, SF).collect():
        t = docs[r["doc_id"]]
        assert r["n_assign"] == sum(len(m[2]) >= 12 for m in assign.finditer(t))
        assert r["n_access"] == sum(len(x) >= 18 for x in re.findall("AKIA[A-Z0-9]+", t))
        assert r["n_hex"] == sum(len(x) >= 16 for x in re.findall("[0-9a-f]+", t))


def test_surrogates_stay_distinct():
    values = [f":555010{i:04d}" for i in range(500)]
    assert len({pii.surrogate("phone", v) for v in values}) == 500
    assert pii.surrogate("phone", values[0]) == pii.surrogate("phone", values[0]) != values[0]


def _rewritten(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in pii.replace(docs).orderBy("doc_id").collect()]


def test_one_person_stays_one_person(spark):
    a, b, c = _rewritten(spark, ["Mr John Smith met Dr Smith. Smith left, John did not.", "Mrs Anna McDonald-Smith wrote to Dr John Smith", "Smith alone is a trade"])
    first, last = a.split()[1:3]
    assert re.fullmatch(rf"Mr {first} {last} met Dr {last}\. {last} left, {first} did not\.", a) and last != "Smith" and first != "John"
    assert re.fullmatch(rf"Mrs [A-Z][a-z]+a [A-Z][a-z][A-Z][a-z]+-{last} wrote to Dr {first} {last}", b)
    assert c == "Smith alone is a trade"


def test_surrogates_keep_their_format(spark):
    card, phone, mail = _rewritten(spark, ["4111 1111 1111 1111", "+44 (20) 7946 0958", "write to John.Smith7@Example.com"])
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card) and pii.luhn(card.replace(" ", "")[:-1]) == int(card[-1])
    assert re.fullmatch(r"\+44 \(\d\d\) \d{4} \d{4}", phone)
    assert re.fullmatch(r"write to [A-Z][a-z]{3}\.[A-Z][a-z]{4}\d@[A-Z][a-z]{6}\.com", mail)


@pytest.mark.parametrize("most", [50_000, 0])
def test_dense_formats_stay_distinct(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST", most)
    local = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"mail {c}@site.org or {c}{c}@site.org" for c in local] + [f"mail {c}@site.org" for c in local]
    new = [tuple(re.findall(r"\S+@\S+", t)) for t in _rewritten(spark, texts)]
    assert new[26:] == [(x,) for x, _ in new[:26]] and len({x for pair in new for x in pair}) == 52
    assert not {x.partition("@")[0] for pair in new for x in pair if x.endswith("@site.org")} & set(local)


def test_pipeline_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    last = corpus_pipeline.STAGES[2][1](spark, first, SF)
    assert last.columns == docs.columns and 0 < last.count() < docs.count()


@pytest.fixture(scope="module")
def net(spark):
    return secret_scan.trained(spark.createDataFrame([], SCHEMA))


def test_secret_threshold_keeps_recall():
    import numpy as np

    shown, labels = secret_scan._synthetic(np.random.default_rng(3), 1600)
    x = np.concatenate([secret_scan.windows(t, [(a, min(e, a + secret_scan.VALUE))]) for t, (a, e) in shown])
    hard = np.where(np.random.default_rng(1).random(len(x)) < 0.2, 1, labels)  # a fifth of the plain tokens are secrets, too
    assert secret_scan.Network().fit(x, hard.astype(float)).threshold < 0.5


def test_secret_inside_a_long_token(net):
    inside = "Zk9qT2vXw7Lr4NbYc1Hs8JdQ5Gm3"
    path = "/".join(["there/other/under", "stories/reading/" + "winter/" * 4, inside, "morning/" * 4 + "thereafter", "reader/into/heaven"])
    plain = path.replace(inside, "somewhere/in/the/long/garden")
    a, b = (secret_scan.windows(f"see {t} in", secret_scan.pieces(4, 4 + len(t))) for t in (path, plain))
    assert net.score(a).max() > net.score(b).max()
    assert [k for *_, k, _ in secret_scan.scan_text(net, [f"see {path} in"])[0]] == ["token"]


def test_unlabelled_secrets_are_no_negatives():
    bare = "the key Zk9qT2vXw7Lr4NbYc1Hs8JdQ5Gm3 or token=Zk9qT2vXw7Lr4NbYc1Hs8JdQ5Gm3 in some_long_name_of_a_thing_12"
    assert [(bare[a:e], y) for a, e, y in secret_scan.labels_of(bare)] == [("Zk9qT2vXw7Lr4NbYc1Hs8JdQ5Gm3", 1), ("some_long_name_of_a_thing_12", 0)]


def _pages(spark, bodies):
    rows = [(i, f"http://a/{i:03d}", x) for i, x in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}


def test_long_boilerplate_goes_from_short_articles(spark):
    rest = "".join(f"<div>The house rules of this place, part {i}</div>" for i in range(9))
    assert _pages(spark, [f"{rest}<div>Story {i}</div>" for i in range(4)]) == {i: f"Story {i}" for i in range(4)}


def test_runs_of_copies_lose_their_furniture(spark):
    page = "<div>Rules</div><div>{} of the long story of a town</div>"
    found = _pages(spark, [page.format("Start")] + [page.format("Middle")] * 40 + [page.format("End")])
    assert found == {i: f"{'Start' if i == 0 else 'End' if i == 41 else 'Middle'} of the long story of a town" for i in range(42)}


def test_language_stage_rejects_what_is_far_from_all(spark):
    import base64
    import random

    import corpus_pipeline

    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(10**9, base64.b64encode(rng.randbytes(900)).decode()), (10**9 + 1, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(150))), (10**9 + 2, "Καλημέρα σε όλους τους φίλους του χωριού και της πόλης " * 9)]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in junk], docs.schema)
    kept = [r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.union(more), SF).select("doc_id").collect()]
    clean = [r["doc_id"] for r in docs.filter("lang IS NOT NULL AND length(text) > 200").collect()]
    assert not {i for i, _ in junk} & set(kept)
    assert set(clean) <= set(kept)
