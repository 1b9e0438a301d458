"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training token windows.

Normalised words are runs of digits, ASCII letters (lower-cased) and anything beyond ASCII. Every ``window``
consecutive words of an item form a window; an item of fewer words is one window. The window hashes of the benchmark
are broadcast, every window of every document is looked up, and each hit is verified word by word.

The broadcast is bounded: items are dealt into parts of at most ``PART_BYTES`` of text, built one at a time. Each has a
scan of the documents, whose hits stand beside the text for the next; one part is the rule.

Defined results: a null or wordless document has no words and no hits; null or wordless items have no windows; a null
item_id counts as an empty one; items that repeat an item_id count once; rows that repeat a doc_id are each judged
alone; empty tables give clean documents. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels
from .arrow import beside, replaced, texts_of
from .shared import keep

WINDOW = 10
#: Most benchmark text that one broadcast holds.
PART_BYTES = 4 << 20
_U = np.uint64


def _runs(w: kernels.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they lie in one text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    run = np.zeros(n - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            run = run * kernels._A + w.hash[j : n - k + 1 + j]
        run = kernels.mix64(run)
    return run, w.doc[: n - k + 1] == w.doc[k - 1 :]


class WindowSet:
    """The windows of some benchmark items by length: sorted hashes, and where each occurs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.items, self.words, found = [x[0] for x in items], [], defaultdict(lambda: defaultdict(list))
        for first, w in kernels.words([x[1] for x in items], kernels.ALNUM):
            bytes_ = [w.low[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            for d in range(w.n_docs):
                self.words.append(bytes_[w.first[d] : w.first[d + 1]])
            for k in sorted({min(window, int(c)) for c in w.count if c}):
                run, ok = _runs(w, k)
                for i in np.flatnonzero(ok):
                    d = int(w.doc[i])
                    if min(window, int(w.count[d])) == k:
                        found[k][int(run[i])].append((first + d, int(i - w.first[d])))
        self.by_length = {}
        for k, at in found.items():
            hashes = np.array(sorted(at), dtype=np.uint64)
            sieve = np.zeros(1 << 16, dtype=bool)
            sieve[hashes >> _U(48)] = True
            self.by_length[k] = (sieve, hashes, at)

    def hits(self, w: kernels.Words) -> Iterator[tuple[int, int, int, set[int]]]:
        """First word, length in words, text and items of each verified window in ``w``."""
        for k, (sieve, hashes, at) in self.by_length.items():
            run, ok = _runs(w, k)
            near = np.flatnonzero(ok & sieve[run >> _U(48)])
            if len(near):
                where = np.searchsorted(hashes, run[near])
                near = near[hashes[np.minimum(where, len(hashes) - 1)] == run[near]]
            for i in near:
                said = [w.low[a:b].tobytes() for a, b in zip(w.start[i : i + k], w.end[i : i + k], strict=True)]
                if items := {n for n, j in at[int(run[i])] if self.words[n][j : j + k] == said}:
                    yield int(i), k, int(w.doc[i]), items


def _scan(windows, texts) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str], kernels.Words, int]]:
    """For each text in order: its place, words, hit stretches of words (merged), items; and its words in their chunk."""
    for first, w in kernels.words(texts, kernels.ALNUM):
        stretches, items = defaultdict(list), defaultdict(set)
        for i, k, d, which in windows.hits(w):
            at = i - int(w.first[d])
            stretches[d].append((at, at + k))
            items[d] |= {windows.items[n] for n in which}
        for d in range(w.n_docs):
            yield first + d, int(w.count[d]), merged(stretches.get(d, ())), items.get(d, set()), w, d


def merged(stretches) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class _parts:
    """A benchmark in parts of at most about ``PART_BYTES`` of text, each built on demand: one is held at a time."""

    def __init__(self, benchmark: DataFrame, window: int):
        self.items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.length("text") > 0)
        self.window, self.n = window, int((self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES) + 1

    def __getitem__(self, i: int) -> WindowSet:
        return WindowSet([tuple(x) for x in self.items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == i).collect()], self.window)


def _digest(n_words: int, stretches, items) -> tuple:
    hit = sum(b - a for a, b in stretches)
    return n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit stretches of words as ``spans``."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    told = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.string()}
    schema = f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"
    parts = _parts(benchmark, window)
    rows = _with_earlier(documents.select("doc_id", "text"), parts)
    held = documents.sparkSession.sparkContext.broadcast(parts[parts.n - 1])

    def run(batches):
        for b in batches:
            found = [(*_digest(n, s, i), ",".join(f"{x}:{y}" for x, y in s)) for n, s, i in _found(held.value, b)]
            columns = zip(*found, strict=True) if found else [[]] * len(told)
            yield beside(b, ["doc_id"], **{name: (values, kind) for (name, kind), values in zip(told.items(), columns, strict=True)})

    return rows.mapInArrow(run, schema)


def _found(windows: WindowSet, b: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Words, hit stretches and items of each row, with what earlier parts of the benchmark found in it."""
    spans, items = (b.column(c).to_pylist() for c in ("_spans", "_items"))
    for at, n, s, i, _, _ in _scan(windows, texts_of(b)):
        yield n, merged([*s, *zip(spans[at][::2], spans[at][1::2], strict=True)]) if spans[at] else s, i | set(items[at] or ())


def _with_earlier(rows: DataFrame, parts: _parts) -> DataFrame:
    """``rows`` with what all parts but the last find in them: words (first, next, first, next ...) and items."""
    passed = rows.columns
    rows = rows.select("*", F.lit(None).cast("array<bigint>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"))

    def gathered(held):
        def run(batches):
            for b in batches:
                found = list(_found(held.value, b))
                yield beside(b, passed, _spans=([[x for y in s for x in y] for _, s, _ in found], pa.list_(pa.int64())), _items=([sorted(i) for *_, i in found], pa.list_(pa.string())))

        return run

    for i in range(parts.n - 1):
        held = rows.sparkSession.sparkContext.broadcast(parts[i])
        rows = keep(rows.mapInArrow(gathered(held), rows.schema), "hits")
        held.unpersist()
    return rows


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``documents`` without the contaminated ones, or (``remove="spans"``) without the hit words; same columns."""
    parts = _parts(benchmark, window)
    rows = _with_earlier(documents.select(F.struct("*").alias("it"), "text"), parts)
    held = documents.sparkSession.sparkContext.broadcast(parts[parts.n - 1])

    def run(batches):
        for b in batches:
            texts, clean = texts_of(b), []
            spans = b.column("_spans").to_pylist()
            for at, _, stretches, _, w, d in _scan(held.value, list(texts)):
                stretches = merged([*stretches, *zip(spans[at][::2], spans[at][1::2], strict=True)]) if spans[at] else stretches
                clean.append(not stretches)
                if stretches and remove == "spans":
                    texts[at] = _cut(texts[at], w, d, stretches)
            out = replaced(b, "text", texts).select(["it", "text"])
            yield out if remove == "spans" else out.filter(pa.array(clean, pa.bool_()))

    out = rows.mapInArrow(run, StructType([rows.schema["it"], rows.schema["text"]]))
    return out.select(*(F.col("text") if c == "text" else F.col("it")[c].alias(c) for c in documents.columns))


def _cut(text: str, w: kernels.Words, d: int, stretches) -> str:
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    base = int(w.begins[d])
    for a, b in stretches:
        i = int(w.first[d])
        out.append(raw[at : w.start[i + a] - base])
        at = w.end[i + b - 1] - base
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


FIND_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), ks as (select distinct k from bw), dw as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)
), h as (
  select dw.r, dw.i, dw.k, bw.item_id from dw join bw on dw.g = bw.g and dw.k = bw.k
), hw as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from h)) group by r
), hi as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from h) group by r
), m as (
  select r, min(i) as a, max(e) as e from (
    select *, sum(fresh) over (partition by r order by i, e) as run from (
      select *, case when i <= max(e) over (partition by r order by i, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
      from (select distinct r, i, i + k as e from h))) group by r, run
), sp as (select r, string_agg(cast(a - 1 as varchar) || ':' || cast(e - 1 as varchar), ',' order by a) as spans from m group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hw.n_hit, 0) as bigint) as n_hit, cast(coalesce(hi.n_items, 0) as bigint) as n_items,
  sha256(coalesce(hi.s, '')) as items_sha256, coalesce(hw.n_hit, 0) > 0 as contaminated, coalesce(sp.spans, '') as spans
from d left join hw on d.r = hw.r left join hi on d.r = hi.r left join sp on d.r = sp.r
"""
