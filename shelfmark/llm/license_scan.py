"""License scans: templates with optional and replaceable regions, compiled into token automata and run over whole texts.

Every template becomes a nondeterministic automaton over words; all share one start. From each word of a text that can
begin a template the automaton runs on as long as any template can go on, its sets of states made deterministic as
they are met. Where a set holds a template's end, the words read so far are accepted: their mandatory wording is the
template's, word for word. For each start and label the longest wording is told. As replaceable regions are bounded, a
start costs no more words than the longest template has, so a text costs its length at most times a constant.

A text is one row of an Arrow batch, never a prefix of it; nothing is shuffled or collected, and only the compiled
templates go to the tasks.

Defined results: a null or wordless text has no words, no places and a score of 0; copies and repeated doc_ids are rows
of their own; an empty table gives an empty one; columns other than doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import beside, texts_of
from .license_templates import TEMPLATES

#: Phrases and the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Letters A-Z become lower case, other ASCII but letters and digits divides words; bytes of further code points stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Sets of states that are remembered at a time; beyond, they are made anew.
REMEMBERED = 50_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


_MARKS = re.compile(r"\[\[|\]\]|\{\{[^:}]*:([^}]*)\}\}|([^\s\[\]{}]+)")


class Automaton:
    """Templates (label, wording) as one automaton. ``next[state]`` are its words' successors, ``other[state]`` those of any word."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.next: list[dict[bytes, set[int]]] = [{}]
        self.other: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.ends: dict[int, str] = {}
        for label, wording in templates:
            at = self._state()
            self.free[0].add(at)
            self.ends[self._template(at, wording)] = label
        self.begin = self._reached({0})
        self.first = frozenset(w for s in self.begin for w in self.next[s])
        self._sets: dict[frozenset, dict[bytes, frozenset]] = {}
        self._labels: dict[frozenset, tuple[str, ...]] = {}
        if any(self.other[s] for s in self.begin) or any(s in self.ends for s in self.begin):
            raise ValueError("a template begins with a word of its own")

    def _state(self) -> int:
        self.next.append({})
        self.other.append(set())
        self.free.append(set())
        return len(self.next) - 1

    def _wording(self, at: int, words: list[bytes]) -> int:
        for w in words:
            to = self._state()
            self.next[at].setdefault(w, set()).add(to)
            at = to
        return at

    def _choice(self, at: int, said: str) -> int:
        end = self._state()
        for one in said.split("|"):
            here = at
            if m := re.match(r"\s*any (\d+)-(\d+)(.*)", one):
                least, most, one = int(m[1]), int(m[2]), m[3]
                after = self._state()
                for i in range(most + 1):
                    if i >= least:
                        self.free[here].add(after)
                    if i < most:
                        to = self._state()
                        self.other[here].add(to)
                        here = to
                here = after
            self.free[self._wording(here, words_of(one))].add(end)
        return end

    def _template(self, at: int, wording: str) -> int:
        skipped: list[int] = []
        for m in _MARKS.finditer(wording):
            if m[0] == "[[":
                skipped.append(at)
                to = self._state()
                self.free[at].add(to)
                at = to
            elif m[0] == "]]":
                to = self._state()
                self.free[at].add(to)
                self.free[skipped.pop()].add(to)
                at = to
            else:
                at = self._choice(at, m[1]) if m[1] is not None else self._wording(at, words_of(m[2]))
        if skipped:
            raise ValueError("an optional region is not closed")
        return at

    def _reached(self, states: set[int]) -> frozenset[int]:
        """The states and all that follow without a word."""
        found, todo = set(states), list(states)
        while todo:
            more = self.free[todo.pop()] - found
            found |= more
            todo += more
        return frozenset(found)

    def _after(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        known = self._sets.setdefault(states, {})
        if word not in known:
            if len(self._sets) > REMEMBERED:
                self._sets.clear()
                self._labels.clear()
                known = self._sets.setdefault(states, {})
            to = {t for s in states for t in (self.next[s].get(word, set()) | self.other[s])}
            known[word] = self._reached(to)
        return known[word]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label) of accepted wordings: the longest of each start and label."""
        out = []
        for i, w in enumerate(words):
            if w not in self.first:
                continue
            states, j, told = self.begin, i, {}
            while states and j < len(words):
                states = self._after(states, words[j])
                j += 1
                if states not in self._labels:
                    self._labels[states] = tuple({self.ends[s] for s in states if s in self.ends})
                for label in self._labels[states]:
                    told[label] = j
            out += [(i, end, label) for label, end in sorted(told.items())]
        return out


def places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, int, str]]:
    """(first word, word after the last, label) of every place of every phrase, by place."""
    out = []
    for phrase, label in phrases.items():
        said = words_of(phrase)
        at = -1
        try:
            while True:
                at = words.index(said[-1], at + 1)
                start = at - len(said) + 1
                if start >= 0 and words[start : at + 1] == said:
                    out.append((start, at + 1, label))
        except ValueError:
            pass
    return sorted(out)


def covered(spans: list[tuple[int, int, str]]) -> int:
    """How many words lie in any of the spans."""
    n, upto = 0, 0
    for a, e, _ in sorted(spans):
        n += max(0, e - max(a, upto))
        upto = max(upto, e)
    return n


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("label", pa.string())]))


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, ``base`` (places of phrases), ``found`` (wordings of templates), as spans of words, and n_covered."""
    held = documents.sparkSession.sparkContext.broadcast(Automaton(templates or TEMPLATES))

    def run(batches):
        for b in batches:
            n, base, found, within = [], [], [], []
            for t in texts_of(b):
                words = words_of(t)
                n.append(len(words))
                base.append(places(words, phrases))
                found.append(held.value.matches(words))
                within.append(covered(base[-1] + found[-1]))
            named = [[[{"first": a, "after": e, "label": x} for a, e, x in spans] for spans in column] for column in (base, found)]
            yield beside(b, ["doc_id"], n_words=(n, pa.int64()), base=(named[0], _SPANS), found=(named[1], _SPANS), n_covered=(within, pa.int64()))

    spans = "array<struct<first: bigint, after: bigint, label: string>>"
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, base {spans}, found {spans}, n_covered bigint")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and the share of a text's words that license wording covers."""
    labels = lambda *spans: F.array_join(F.sort_array(F.array_distinct(F.concat(*(F.col(s)["label"] for s in spans)))), ",")
    starts = F.col("base")["first"]
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), F.coalesce(F.try_divide("n_covered", "n_words"), F.lit(0.0)).alias("score"),
    )
