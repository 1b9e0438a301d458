"""The methods of operators that SQL cannot express, against brute force or planted truth, and the pipeline end to end."""

import random

import numpy as np

import corpus_pipeline
from shelfmark.llm import fingerprints, language, quality, secret_scan
from tests.conftest import SF


def test_likeness_follows_true_similarity(spark):
    """Mean error of the bias-corrected likeness against the true similarity of edited texts."""
    rng, rows = random.Random(4), []
    for i in range(120):
        rows.append((i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(150, 600)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = dict(rows)

    def similarity(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
        return len(x & y) / len(x | y)

    order, wrong = sorted(text, reverse=True), []
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in fingerprints.fingerprint(docs).collect():
        t, n = text[r["doc_id"]], text[after[r["doc_id"]]]
        k = len(t) // 3
        wrong.append(abs(r["near_edited"] - similarity(t, t[: len(t) - k] + n[:k])))
        assert r["near_next"] < 0.25
    assert np.mean(wrong) < 0.08


def test_distances_against_plain_python():
    """The out-of-place distance of small texts, told again with dictionaries of n-gram strings."""
    from collections import Counter

    def grams(t):
        out = Counter()
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            w = f" {w} "
            for n in (1, 2, 3):
                out.update(g for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip())
        return out

    for t in ("Der Hund, die Katze!", "a", "Straße und Weg 12 und Weg", "été à la mer"):
        h, _, has = language._grams([t])
        assert has[0] and len(h) == sum(grams(t).values()) and len(set(h.tolist())) == len(grams(t))
    text, other = "the cat and the dog and the bird", "der hund und die katze und der vogel"
    table = {}
    for lang, t in (("a", text), ("b", other)):
        gram, _, place, _ = language._ranked([t])
        table[lang] = np.full(language._SIZE, -1, dtype=np.int16)
        table[lang][gram] = place
    said, score, far = language._predict(table, [text, other, "dog and cat", "12 !"])
    assert said == ["a", "b", "a", "und"] and far[:2] == [0.0, 0.0] and score[3] == 0.0
    gram, _, place, _ = language._ranked(["dog and cat"])
    want = np.mean([abs(int(table["a"][g]) - p) if table["a"][g] >= 0 else language.PROFILE for g, p in zip(gram, place, strict=True)])
    assert abs(far[2] - want) < 1e-9


def test_labellers_accuracies_are_found():
    """Votes drawn from planted chances: posteriors agree with the truth, and the better labellers are found to be so."""
    rng, n = np.random.default_rng(2), 20_000
    good = rng.random(n) < 0.8
    catches = np.linspace(0.9, 0.3, len(quality.LABELLERS))
    votes = np.where(~good[:, None] & (rng.random((n, len(catches))) < catches), "-", "+")
    patterns, truth = {}, {}
    for row, g in zip(map("".join, votes), good, strict=True):
        patterns[row] = patterns.get(row, 0) + 1
        truth.setdefault(row, []).append(g)
    posterior, chance, prior = quality.estimate(patterns)
    right = sum(sum(g == (posterior[k] > 0.5) for g in v) for k, v in truth.items())
    assert right > 0.98 * n and abs(prior - 0.8) < 0.03
    assert np.corrcoef(chance[:, 0], catches)[0, 1] > 0.95


def test_calibration_converges():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=4000) * 3
    truth = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * raw - 1)))).astype(float)
    scale, shift = secret_scan.platt(raw, truth)
    assert abs(scale - 0.5) < 0.06 and abs(shift + 1) < 0.12
    assert all(np.isfinite(secret_scan.platt(np.array([-3.0, -2, 2, 3]), np.array([0.0, 0, 1, 1]))))


def test_pipeline_keeps_and_drops_what_was_planted(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    source = docs.filter("lang = 'en' AND length(text) BETWEEN 800 AND 4000").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    new = " ".join(random.Random(8).sample(source.split(), 90))
    planted = [(top + 1, new), (top + 2, new), (top + 3, new + " ending"), (top + 4, f"{' '.join(random.Random(9).sample(source.split(), 60))} {item}"), (top + 5, None), (top + 6, f"{' '.join(random.Random(7).sample(source.split(), 80))} token=Zk9qT2vXw7Lr4NbYc1Hs8")]
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted], docs.schema))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {i for i, _ in planted} & kept == {top + 1, top + 6}
    pieces = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        pieces = stage(spark, pieces, str(tmp_path))
        assert pieces.columns == docs.columns, name
