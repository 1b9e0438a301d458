"""Language identification by rank-order profiles (out-of-place distance between n-gram rankings).

A text is lower-cased and cut into words of letters, padded by one blank on either side; its n-grams of 1 to 3 letters
are counted by 20-bit hash. A language's profile is the ranking of its ``PROFILE`` most frequent n-grams over all
training texts; a document's profile is its own ranking. The distance to a language sums, over the document's
n-grams, how many places each is away from its place there (``PROFILE`` where absent). The nearest language wins.

Training counts all texts of known language outside the held-out fifth. Sums per language and n-gram are taken in
each task before the shuffle; what the driver gets is ``PROFILE`` rows a language.

Filtering also rejects texts that are far from every profile: other languages, encoded bytes, random letters. The
distance per n-gram to the nearest profile must not exceed the upper quartile plus ``FENCE`` times the distance between
the quartiles, both over all training texts; with fewer than ``KNOWN`` of these there is no bound.

Defined results: null text, or text without a letter, is ``und`` with score 0; null lang or null text trains nothing;
without training rows everything is ``und``; ties go to the smaller language by code point; a null doc_id is held out
as the empty text is; rows that repeat a doc_id are each predicted;
identifiers keep all their bits beside nulls. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import beside, texts_of

PROFILE, BITS = 400, 20
FENCE, KNOWN = 3.0, 20
#: Texts and characters that are worked on at once.
DOCS, CHARS = 1 << 11, 1 << 18
_SIZE = 1 << BITS


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _groups(texts) -> Iterator[tuple[int, list[str]]]:
    held, total, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if held and (total + len(t) > CHARS or len(held) >= DOCS):
            yield first, held
            held, total, first = [], 0, i
        held.append(t)
        total += len(t) + 2
    if held:
        yield first, held


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every n-gram; which texts have letters."""
    c = np.frombuffer(f" {'  '.join(texts)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _letters()[c]
    d = np.repeat(np.arange(len(texts), dtype=np.uint32), np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (d[1:] != d[:-1])
    c, d = c[keep], d[keep]
    a, b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
    x = c + np.uint32(1)  # blanks count, too: with 0 for them " d" would hash as "d"
    one = x * a
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * b + x[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * a + x[2:]
    is1 = c != 0
    is2 = (is1[:-1] | is1[1:]) & (d[:-1] == d[1:])
    is3 = is1[1:-1] & (d[:-2] == d[2:])
    h = np.concatenate((one[is1], (two * a)[is2], (three * b)[is3]))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    has = np.bincount(d[is1], minlength=len(texts)) > 0
    return h >> np.uint32(32 - BITS), np.concatenate((d[is1], d[:-1][is2], d[:-2][is3])), has


def _ranked(texts: list[str], most: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's most frequent n-grams: hash, text, place from 0; and which texts have letters."""
    h, d, has = _grams(texts)
    key = np.sort((d << np.uint32(BITS)) | h)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    rare = (_SIZE - 1 - np.minimum(n, _SIZE - 1)).astype(np.uint64)
    low = np.uint64(_SIZE - 1)
    order = np.sort(((key.astype(np.uint64) >> np.uint64(BITS)) << np.uint64(2 * BITS)) | (rare << np.uint64(BITS)) | (key.astype(np.uint64) & low))
    d = (order >> np.uint64(2 * BITS)).astype(np.int64)
    place = np.arange(len(d)) - np.searchsorted(d, d, side="left")
    top = place < most
    return (order & low)[top].astype(np.int64), d[top], place[top], has


def _held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def _training(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out()).select("lang", "text")


def profiles(documents: DataFrame) -> dict[str, np.ndarray]:
    """Each language's place of every n-gram hash, -1 for none; learnt from ``documents`` (doc_id, text, lang)."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                for _, some in _groups(texts):
                    if lang not in sums and len(sums) == 8:  # as many tables as fit; what they hold goes on
                        yield from told(sums)
                    sums.setdefault(lang, np.zeros(_SIZE, dtype=np.int64))
                    sums[lang] += np.bincount(_grams(some)[0], minlength=_SIZE)
        yield from told(sums)

    def told(sums):
        while sums:
            lang, n = sums.popitem()
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": n[at]})

    counted = _training(documents).mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    places = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    out: dict[str, np.ndarray] = {}
    for lang, gram, place in counted.withColumn("place", places).filter(F.col("place") < PROFILE).select("lang", "gram", "place").collect():
        out.setdefault(lang, np.full(_SIZE, -1, dtype=np.int16))[gram] = place
    return dict(sorted(out.items()))


def _predict(held: dict[str, np.ndarray], texts) -> tuple[list[str], list[float], list[float]]:
    """Of each text: language, score, and distance per n-gram to that language."""
    langs, said, scores, fars = list(held), [], [], []
    table = np.stack(list(held.values())) if held else None
    for _, some in _groups(texts):
        if table is None:
            said += ["und"] * len(some)
            scores += [0.0] * len(some)
            fars += [0.0] * len(some)
            continue
        gram, d, place, has = _ranked(some)
        at = table[:, gram].astype(np.int64)
        apart = np.where(at < 0, PROFILE, np.abs(at - place))
        far = np.stack([np.bincount(d, weights=x, minlength=len(some)) for x in apart])
        n = np.maximum(np.bincount(d, minlength=len(some)), 1)
        best = far.argmin(axis=0)
        first = np.take_along_axis(far, best[None], 0)[0]
        second = np.partition(far, 1, axis=0)[1] if len(langs) > 1 else (n * PROFILE).astype(float)
        sure = np.clip(1 - first / np.maximum(second, 1e-9), 0, 1)
        said += [langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
        scores += [float(x) if ok else 0.0 for x, ok in zip(sure, has, strict=True)]
        fars += (first / n).tolist()
    return said, scores, fars


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. The score is how much nearer the first language is than the second."""
    held = documents.sparkSession.sparkContext.broadcast(_packed(profiles(documents)))

    def run(batches):
        table = _unpacked(held.value)
        for b in batches:
            said, scores, _ = _predict(table, texts_of(b))
            yield beside(b, ["doc_id", "held_out"], lang_pred=(said, pa.string()), score=(scores, pa.float64()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _packed(places: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    return [(k, at := np.flatnonzero(v >= 0), v[at]) for k, v in places.items()]


def _unpacked(packed) -> dict[str, np.ndarray]:
    out = {}
    for lang, at, v in packed:
        out[lang] = np.full(_SIZE, -1, dtype=np.int16)
        out[lang][at] = v
    return out


def bound_of(counts: dict[int, int]) -> float:
    """The greatest distance that is still near; from how many training texts have each whole distance."""
    far = np.repeat(sorted(counts), [counts[x] for x in sorted(counts)])
    if len(far) < KNOWN:
        return float(PROFILE)
    low, high = far[len(far) // 4], far[3 * len(far) // 4]
    return float(high + FENCE * max(high - low, 1))


def bound(documents: DataFrame, packed) -> float:
    """Bound of the distance per n-gram to the nearest profile, learnt from every training text of ``documents``."""
    held = documents.sparkSession.sparkContext.broadcast(packed)

    def count(batches):
        table = _unpacked(held.value)
        for b in batches:
            said, _, fars = _predict(table, b["text"])
            frame = pd.DataFrame({"far": np.ceil(fars).astype(np.int64), "n": 1})[np.array([x != "und" for x in said], dtype=bool)]
            yield frame.groupby("far", as_index=False)["n"].sum()

    return bound_of({far: n for far, n in _training(documents).mapInPandas(count, "far int, n bigint").groupBy("far").agg(F.sum("n")).collect()})


def keep_identified(documents: DataFrame, languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """``documents`` without those whose language is ``und``, too far from all, not in ``languages`` (None: any learnt), or below score ``least``."""
    packed = _packed(profiles(documents))
    held = documents.sparkSession.sparkContext.broadcast((packed, bound(documents, packed)))

    def run(batches):
        table, near = _unpacked(held.value[0]), held.value[1]
        for b in batches:
            told = zip(*_predict(table, texts_of(b)), strict=True)
            ok = [x != "und" and s >= least and far <= near and (languages is None or x in languages) for x, s, far in told]
            yield b.filter(pa.array(ok, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
