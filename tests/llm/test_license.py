"""License scans against plain recursion over the templates, and on odd rows."""

import random
import re

import pytest

from shelfmark.llm import license_scan
from shelfmark.llm.license_templates import TEMPLATES


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def ends(marks, i, at, said):
    """Every place where what is left of a template, from mark ``i``, may end when it goes on at word ``at``."""
    if i == len(marks):
        return {at}
    m = marks[i]
    if m == "[[":
        depth, j = 1, i
        while depth:
            j += 1
            depth += {"[[": 1, "]]": -1}.get(marks[j], 0)
        return ends(marks, i + 1, at, said) | ends(marks, j + 1, at, said)
    if m == "]]":
        return ends(marks, i + 1, at, said)
    if m.startswith("{{"):
        out = set()
        for one in m[2:-2].split(":", 1)[1].split("|"):
            least, most = 0, 0
            if any_ := re.match(r"\s*any (\d+)-(\d+)(.*)", one):
                least, most, one = int(any_[1]), int(any_[2]), any_[3]
            for n in range(least, most + 1):
                upto = at + n
                if upto + len(one.split()) <= len(said) and said[upto : upto + len(one.split())] == one.split():
                    out |= ends(marks, i + 1, upto + len(one.split()), said)
        return out
    return ends(marks, i + 1, at + 1, said) if at < len(said) and said[at] == m else set()


def plain_matches(text, templates):
    said, out = words(text), {}
    for label, wording in templates:
        marks = re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+", wording)
        for at in range(len(said)):
            for end in ends(marks, 0, at, said):
                out[at, label] = max(out.get((at, label), 0), end)
    return sorted((a, e, label) for (a, label), e in out.items())


SMALL = [
    ("x", "use [[of [[the]]]] {{what: code|any 1-3 text}} is free"),
    ("y", "use {{who: any 0-2}} is {{how: free|not free}} [[at all]]"),
    ("x", "free to {{b: any 0-1|use}} all [[or {{c: any 1-2}}]] end"),
]


def test_automata_against_recursion():
    rng, auto, n = random.Random(5), license_scan.Automaton(SMALL), 0
    vocabulary = "use of the code text is free not at all to or end é".split()
    for _ in range(1500):
        pieces = [filled(rng.choice(SMALL)[1], rng) if rng.random() < 0.6 else rng.choice(vocabulary) for _ in range(rng.randrange(8))]
        text = " ".join(w for p in pieces for w in p.split() if rng.random() < 0.97)
        want = plain_matches(text, SMALL)
        n += len(want)
        assert sorted(auto.matches(license_scan.words_of(text))) == want
    assert n > 1000


def filled(wording, rng, spoil=False):
    """A text of a template: optional regions in or out, others replaced, and one mandatory word changed where spoilt."""
    text = wording
    while "[[" in text:
        text = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: m[1] if rng.random() < 0.5 else " ", text)

    def replacement(m):
        one = rng.choice(m[1].split("|"))
        if any_ := re.match(r"\s*any (\d+)-(\d+)(.*)", one):
            return " ".join(["acme"] * rng.randint(int(any_[1]), int(any_[2]))) + any_[3]
        return one

    mandatory = re.sub(r"\{\{.*?\}\}", " ", re.sub(r"\[\[.*?\]\]", " ", text)).split()
    text = re.sub(r"\{\{[^:}]*:(.*?)\}\}", replacement, text)
    if spoil:
        said = text.split()
        at = rng.choice([i for i, w in enumerate(said) if w in mandatory and w != "acme"])
        said[at] = "zebra"
        text = " ".join(said)
    return text


def test_every_template_is_accepted_and_no_other_wording():
    rng, auto = random.Random(6), license_scan.Automaton(TEMPLATES)
    for label, wording in TEMPLATES:
        for _ in range(4):
            text = f"Some words before, {filled(wording, rng).upper()}; and, after: more."
            said = license_scan.words_of(text)
            assert (3, len(said) - 3, label) in [(a, e, x) for a, e, x in auto.matches(said)] or any(x == label and a == 3 for a, _, x in auto.matches(said)), (label, text)
            if len(wording.split()) > 40:
                assert not any(a == 3 and e == len(said) - 3 for a, e, _ in auto.matches(license_scan.words_of(f"some words before {filled(wording, rng, True)} and after more")))


def plain_summary(doc_id, text):
    said = words(text)
    base = [(i, i + len(p.split()), x) for p, x in license_scan.PHRASES.items() for i in range(len(said)) if said[i : i + len(p.split())] == p.split()]
    more = plain_matches(text, TEMPLATES)
    hit = {j for a, e, _ in base + more for j in range(a, e)}
    starts = [a for a, *_ in base]
    return (str(doc_id), len(said), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for *_, x in base})), ",".join(sorted({x for *_, x in base + more})), round(len(hit) / len(said), 12) if said else 0.0)


def test_summary_against_plain_python(spark):
    rng, rows = random.Random(7), [(1, None), (2, ""), (3, " \n\t.,;"), (4, "MIT License"), (4, "mit-license mit  LICENSE"), (None, "Apache License, apache license é general public license mit")]
    rows += [(i + 10, filled(w, rng, i % 3 == 0) + " und weiter mit license") for i, (_, w) in enumerate(TEMPLATES)]
    rows += [(90, "Released under the MIT License"), (91, "Licensed under CC BY-NC 4"), (92, "licensed under the " * 300 + "mit license " * 300), (93, "This work is licensed under the GNU General Public License, version 3"), (94, "words " * 50_000 + "Licensed under the Apache License, Version 2")]
    rows += [rows[3]] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).selectExpr("*", "1 as n_words", "2 as base", "'z' as label")
    got = license_scan.summary(license_scan.scan(docs))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    told = sorted(((str(r["doc_id"]), *r[1:7], round(r["score"], 12)) for r in got.collect()), key=str)
    assert told == sorted((plain_summary(*r) for r in rows), key=str)
    labels = {r["doc_id"]: r["labels"] for r in got.collect()}
    assert labels[90] == "mit" and labels[91] == "cc-by-nc" and labels[93] == "gpl,gpl-3.0" and labels[94] == "apache,apache-2.0"
    assert license_scan.summary(license_scan.scan(docs.limit(0))).count() == 0


def test_sets_of_states_are_made_anew(monkeypatch):
    text = filled(TEMPLATES[3][1], random.Random(1))
    want = license_scan.Automaton(TEMPLATES).matches(license_scan.words_of(text))
    monkeypatch.setattr(license_scan, "REMEMBERED", 3)
    assert want and license_scan.Automaton(TEMPLATES).matches(license_scan.words_of(text)) == want


@pytest.mark.parametrize("wording", ["{{a: any 0-2}} x", "[[x]]", "a [[b"])
def test_templates_that_cannot_be(wording):
    with pytest.raises(ValueError):
        license_scan.Automaton([("x", wording)])
