"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

A text's shingles are its runs of five words (a shorter text's whole run). Each shingle is hashed once; the high bits
choose one of ``BINS`` bins, the low bits compete for the bin's minimum. An empty bin copies the first filled bin along
a fixed random order of its own. Of every bin the lowest ``BITS`` bits are kept and packed. Two fingerprints agree in a
bin by chance with probability ``2**-BITS``; the likeness is the share of equal bins with that bias taken out.

Defined results: null and blank texts have the empty fingerprint, alike (1.0) to each other and to nothing else (0.0);
equal texts have equal fingerprints; rows that repeat a doc_id are each fingerprinted, in order of their text; a single
row is its own next; an empty table gives an empty one. doc_id null sorts before all. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .ordering import in_order

SHINGLE, BINS, BITS = 5, 512, 4
_U = np.uint64
_EMPTY = ~_U(0)


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it asks the others, and the place of each other in it."""
    rng = np.random.default_rng(20240229)
    order = np.argsort(rng.random((BINS, BINS)), axis=1).astype(np.int16)
    return order, np.argsort(order, axis=1).astype(np.int16)


_ASKS, _PLACE = _orders()
#: Below so many filled bins an empty bin looks for the nearest at once, instead of asking one after the other.
_SPARSE = 24


def sketches(texts) -> np.ndarray:
    """One row of ``BINS`` small integers a text; all -1 for a text without words."""
    out = np.full((len(texts), BINS), -1, dtype=np.int8)
    for first, w in kernels.words(texts, kernels.NOT_SPACE, most=512):
        with np.errstate(over="ignore"):
            run, doc = w.shingles(SHINGLE)
        low = np.full(w.n_docs * BINS, _EMPTY, dtype=np.uint64)
        np.minimum.at(low, doc * BINS + (run >> _U(64 - BINS.bit_length() + 1)).astype(np.int64), run & _U((1 << 55) - 1))
        low = low.reshape(w.n_docs, BINS)
        filled = low != _EMPTY
        n = filled.sum(axis=1)
        for d in np.flatnonzero((n > 0) & (n < _SPARSE)):
            have, none = np.flatnonzero(filled[d]), np.flatnonzero(~filled[d])
            low[d, none] = low[d, have[_PLACE[none][:, have].argmin(axis=1)]]
        d, b = np.nonzero(~filled & (n >= _SPARSE)[:, None])
        for turn in range(BINS):
            if not len(d):
                break
            asked = _ASKS[b, turn]
            ok = filled[d, asked]
            low[d[ok], b[ok]] = low[d[ok], asked[ok]]
            d, b = d[~ok], b[~ok]
        some = np.flatnonzero(n > 0)
        out[first + some] = (low[some] & _U((1 << BITS) - 1)).astype(np.int8)
    return out


def packed(sketch: np.ndarray) -> list[str]:
    """Hexadecimal text of each sketch, two bins a byte; empty for the empty sketch."""
    bits = np.maximum(sketch, 0).astype(np.uint8)
    both = (bits[:, 0::2] << 4) | bits[:, 1::2]
    return [x.tobytes().hex() if ok else "" for x, ok in zip(both, sketch[:, 0] >= 0, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of each pair of sketches, 0 to 1."""
    chance = 2.0**-BITS
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    no_a, no_b = a[:, 0] < 0, b[:, 0] < 0
    return np.where(no_a | no_b, (no_a & no_b).astype(float), est)


def fingerprint(documents: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its edited text, in which the last third gives way to the next document's start.

    The next document is the one with the largest smaller doc_id; after the smallest comes the largest.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = in_order(rows, ["_key"], circular=True, ties=["text"]).select("doc_id", "text", "_halo")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        before = None  # the row before: its text and sketch
        for b in batches:
            texts, own = list(b["text"]), b["_halo"].to_numpy() == 0
            if not len(texts):
                continue
            sketch = sketches(texts)
            past = texts[:1] if before is None else [before[0]]
            past_sketch = sketch[:1] if before is None else before[1]
            nexts, next_sketch = [*past, *texts[:-1]], np.concatenate((past_sketch, sketch[:-1]))
            before = texts[-1], sketch[-1:]
            mine = np.flatnonzero(own)
            edited = [t[: len(t) - len(t) // 3] + nexts[i][: len(t) // 3] for i in mine for t in (texts[i],)]
            changed = sketches(edited)
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].to_numpy()[mine], "n_chars": [len(texts[i]) for i in mine],
                    "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
                    "fingerprint": packed(sketch[mine]), "edited_fingerprint": packed(changed),
                    "near_edited": likeness(sketch[mine], changed), "near_next": likeness(sketch[mine], next_sketch[mine]),
                }, columns=columns,
            )

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInPandas(run, schema)
