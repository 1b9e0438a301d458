"""Vectorised text kernels that run inside Spark tasks, on one Arrow batch at a time.

Texts of a batch are laid end to end as UTF-8 bytes and cut into chunks of about a quarter of a megabyte, so that
memory is bounded by the chunk (or by the longest single text). Words get 64-bit polynomial hashes from one
cumulative sum over the bytes; shingles get theirs from the word hashes. No text is cut or skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x = x * _M2
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_P, _A = 0x5851F42D4C957F2D | 1, _U(0xD6E8FEB86659FD93)
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 8 * CHUNK:
            _powers[kind] = have
    return have


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, lower-case ASCII letters and all beyond ASCII (applied after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words:
    """The words of some texts: ``hash`` of each, ``doc`` it is in, ``start`` and ``end`` in ``low``; ``count`` by text."""

    def __init__(self, encoded: list[bytes], table: np.ndarray):
        n = len(encoded)
        buf = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
        self.n_docs, self.low = n, LOWER[buf]
        ends_at = np.cumsum(np.fromiter((len(x) + 1 for x in encoded), dtype=np.int64, count=n))
        self.begins = np.concatenate(([0], ends_at[:-1]))
        inside = table[self.low]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(ends_at, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        total = np.empty(len(buf) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.low] * _power("p", _P, len(buf))[: len(buf)], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * _power("q", _P_INV, len(buf))[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words with the text each is in, in order of text; a shorter text is one run."""
        h, n = self.hash, len(self.hash)
        if n >= k:
            run = np.zeros(n - k + 1, dtype=np.uint64)
            for j in range(k):
                run = run * _A + h[j : n - k + 1 + j]
            ok = self.doc[: n - k + 1] == self.doc[k - 1 :]
            run, doc = mix64(run[ok]), self.doc[: n - k + 1][ok]
        else:
            run, doc = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            whole = np.empty(len(short), dtype=np.uint64)
            for i, d in enumerate(short):
                x = _U(self.count[d])
                for y in h[self.first[d] : self.first[d + 1]]:
                    x = x * _A + y
                whole[i] = x
            run, doc = np.concatenate((run, mix64(whole + _U(0x51)))), np.concatenate((doc, short))
            order = np.argsort(doc, kind="stable")
            run, doc = run[order], doc[order]
        return run, doc


def chunks(texts, size: int = CHUNK, most: int = 4096) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive texts (null: empty) as UTF-8, about ``size`` bytes or ``most`` at a time: first index, next index, bytes."""
    held, total, first = [], 0, 0
    for i, t in enumerate(texts):
        x = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and (total + len(x) > size or len(held) >= most):
            yield first, i, held
            held, total, first = [], 0, i
        held.append(x)
        total += len(x) + 1
    if held:
        yield first, first + len(held), held


def words(texts, table: np.ndarray, size: int = CHUNK, most: int = 4096) -> Iterator[tuple[int, Words]]:
    """The words of consecutive texts, with the index of the first; ``table`` says which bytes make words."""
    for first, _, encoded in chunks(texts, size, most):
        with np.errstate(over="ignore"):
            yield first, Words(encoded, table)


def distinct_sets(run: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    return [np.unique(run[at[i] : at[i + 1]]) for i in range(n_docs)]


def apart_from(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ``spans``, disjoint and in order, that overlap none of ``taken``: one walk along both."""
    ends, out, at, reach = sorted(taken), [], 0, 0
    for a, b in spans:
        while at < len(ends) and ends[at][0] < b:
            reach = max(reach, ends[at][1])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out
