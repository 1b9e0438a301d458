"""Quality by weak supervision: labellers vote, expectation-maximisation weighs them, a hashed linear scorer learns.

Each labeller is a rule over a whole text that votes good (1), bad (-1) or nothing (0). What the estimation needs of the
corpus is how often each pattern of votes occurs, counted over all documents; there are at most ``3 ** len(LABELLERS)``
patterns, whatever the input. From these counts expectation-maximisation finds every labeller's chance of each vote on
good and bad documents, and so each pattern's posterior. The scorer is logistic, over hashed byte trigrams and word
shapes averaged over the document, and learns the posteriors of all documents: votes and features of every row are written
once, and each of at most ``ROUNDS`` Newton steps is one pass over them that sums loss, gradient and curvature, whose size
is fixed. The threshold, a multiple of ``1 / GRID``, keeps ``RECALL`` of all documents whose posterior is good.

Defined results: null, empty and blank texts get no votes, score 0 and are not kept; rows that repeat a doc_id are
each scored; with no documents, or none of one kind, the prior stands and the result is still defined; an empty table
gives an empty one. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .arrow import beside, texts_of
from .shared import keep, partitions

ROUNDS, RIDGE, RECALL, GRID, MISFIRE = 10, 1e-6, 0.998, 1 << 16, 0.0005
TRIGRAMS, SHAPES, RATIOS = 1 << 8, 1 << 6, 1 << 6
FEATURES = TRIGRAMS + SHAPES + RATIOS


def _between(x: float, bad, good) -> int:
    return -1 if bad(x) else 1 if good(x) else 0


#: Rules over what ``measures`` finds: vote -1, 0 or 1.
LABELLERS = {
    "capitals": lambda m: -(m["capitals"] > 0.3),
    "symbols": lambda m: -(m["symbols"] > 0.1),
    "bars": lambda m: -(m["bars"] > 0.2),
    "variety": lambda m: 0 if m["n"] < 20 else _between(m["variety"], lambda x: x < m["usual"] / 2, lambda x: x > m["usual"] * 0.8),
    "echo": lambda m: -(m["echo"] > 0.2),
    "endings": lambda m: _between(m["endings"], lambda x: x < 0.5, lambda x: x > 0.9),
    "lines": lambda m: 0 if m["n_lines"] < 3 else _between(m["repeated_lines"], lambda x: x > 0.3, lambda x: x < 0.1),
    "word length": lambda m: _between(m["length"], lambda x: not 2 <= x <= 12, lambda x: 3 <= x <= 9),
}


def measures(text: str) -> dict[str, float] | None:
    words = text.split()
    if not words:
        return None
    n, lines = len(words), [x.strip() for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#$%&*!"))
    return {
        "n": n, "capitals": sum(w.isupper() and len(w) > 1 for w in words) / n, "symbols": symbols / n, "bars": text.count("|") / n,
        "variety": len(set(words)) / n, "usual": min(1.0, 2.2 / n**0.2), "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "endings": sum(x[-1] in ".!?…" for x in lines) / len(lines), "n_lines": len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "length": sum(map(len, words)) / n,
    }


def votes(text) -> str:
    """One character a labeller: ``+``, ``-`` or ``0``; empty for a text without words."""
    m = measures(text) if isinstance(text, str) else None
    return "".join("0+-"[rule(m)] for rule in LABELLERS.values()) if m else ""


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good by pattern, each labeller's chances of a vote against (bad, good), and the prior of good.

    A labeller that does not vote says nothing either way, except those that only ever vote against. No labeller is
    taken to vote against more than ``MISFIRE`` of the good documents: what fires is worth hearing however many rules,
    made for other faults, find nothing.
    """
    known = {k: n for k, n in patterns.items() if k}
    if not known:
        return {}, np.full((len(LABELLERS), 2), 0.5), 0.5
    votes_ = np.array([["-0+".index(c) for c in k] for k in known])
    n = np.array(list(known.values()), dtype=float)
    votes_ = np.where((votes_ == 2).any(axis=0) | (votes_ == 0), votes_, 2)  # of those that never vote in favour, silence is a vote in favour
    good = 0.97 * 0.2 ** (votes_ == 0).sum(axis=1)  # to begin with, each vote against counts for much: they are rarer than votes in favour
    for _ in range(rounds):
        weight = np.stack(((1 - good) * n, good * n))
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        against, cast = weight @ (votes_ == 0), weight @ (votes_ != 1)
        chance = ((against + [[2], [0.1]]) / (cast + [[4], [100]])).T
        chance[:, 1] = np.minimum(chance[:, 1], MISFIRE)
        told = np.log(chance[:, 1] / chance[:, 0]), np.log((1 - chance[:, 1]) / (1 - chance[:, 0]))
        odds = np.log(prior / (1 - prior)) + (votes_ == 0) @ told[0] + (votes_ == 2) @ told[1]
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(known, good.tolist(), strict=True)), chance, float(prior)


def features(texts):
    """For each chunk of texts: index of the first, feature numbers, their weights, and the text each is in."""
    for first, _, encoded in kernels.chunks(texts):
        n = len(encoded)
        buf = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8).astype(np.uint32)
        long = np.fromiter(map(len, encoded), dtype=np.int64, count=n)
        doc = np.repeat(np.arange(n), long + 1)
        tri = (buf[:-2] * np.uint32(0x9E3779B1)) ^ (buf[1:-1] * np.uint32(0x85EBCA6B)) ^ (buf[2:] * np.uint32(0xC2B2AE35)) if len(buf) > 2 else np.zeros(0, dtype=np.uint32)
        tri = (tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
        of = doc[: len(tri)]
        ids, weights, docs = [tri.astype(np.int64)], [1.0 / np.maximum(long[of], 1)], [of]
        with np.errstate(over="ignore"):
            w = kernels.Words(encoded, kernels.NOT_SPACE)
        if len(w.hash):
            same = np.zeros(len(w.hash), dtype=np.int64)
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
            upper = (buf[w.start] >= 65) & (buf[w.start] <= 90)
            last = buf[w.end - 1]
            shape = same * 32 + upper * 16 + np.minimum((w.end - w.start) // 4, 3) * 4 + np.where(last < 48, 1, 0) + np.where(last == 46, 2, 0)
            distinct = np.array([len(np.unique(w.hash[w.first[d] : w.first[d + 1]])) for d in range(n)])
            ratio = np.minimum((7.99 * distinct / np.maximum(w.count, 1)).astype(np.int64), 7) * 8 + np.minimum(np.log2(np.maximum(w.count, 1)).astype(np.int64) // 2, 7)
            some = np.flatnonzero(w.count)
            ids += [TRIGRAMS + shape, TRIGRAMS + SHAPES + ratio[some]]
            weights += [1.0 / w.count[w.doc], np.full(len(some), 0.3)]
            docs += [w.doc, some]
        yield first, np.concatenate(ids), np.concatenate(weights), np.concatenate(docs), n


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def observed(documents: DataFrame) -> DataFrame:
    """doc_id, votes and features of every row, the features as 16-bit floats."""

    def run(batches):
        for b in batches:
            texts, rows = texts_of(b), []
            for _, ids, weights, docs, n in features(texts):
                rows += [r.tobytes() for r in np.bincount(docs * FEATURES + ids, weights=weights, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float16)]
            yield beside(b, ["doc_id"], votes=([votes(t) for t in texts], pa.string()), x=(rows, pa.binary()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return keep(documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes string, x binary"), "observed")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Features of a batch's rows, and a one for the bias."""
    x = np.ones((batch.num_rows, FEATURES + 1), dtype=np.float32)
    x[:, :-1] = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float16).reshape(batch.num_rows, FEATURES)
    return x


def _sums(rows: DataFrame, posterior: dict[str, float], balance: tuple[float, float], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at ``w`` over all rows that have votes; a bad document weighs ``balance[0]``, a good one ``balance[1]``."""

    def add(batches):
        loss, gradient, curvature = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for b in batches:
            y = np.array([posterior.get(v, -1.0) for v in b.column("votes").to_pylist()])
            x, y = _matrix(b)[y >= 0], y[y >= 0]
            z, weight = x @ w, np.where(y > 0.5, balance[1], balance[0])
            p = _chance(z)
            loss += float(weight @ (np.logaddexp(0, z) - y * z))
            gradient += (weight * (p - y)) @ x
            curvature += (x * (weight * p * (1 - p)).astype(np.float32)[:, None]).T @ x
        rows = [np.append(loss, gradient), *(curvature[i, i:] for i in range(len(w)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["i", "sums"])

    def either(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["i"], b["sums"], strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x)
        yield pd.DataFrame({"i": list(sums), "sums": [x.tobytes() for x in sums.values()]}).astype({"i": "int32"})

    schema = "i int, sums binary"
    n = partitions(rows.sparkSession)
    found = {r["i"]: np.frombuffer(bytes(r["sums"])) for r in rows.select("votes", "x").mapInArrow(add, schema).repartition(min(n, 16), "i").mapInPandas(either, schema).collect()}
    curvature = np.zeros((len(w), len(w)))
    for i in range(len(w)):
        curvature[i, i:] = curvature[i:, i] = found[i + 1]
    return float(found[0][0]), found[0][1:], curvature


def _fit(rows: DataFrame, posterior: dict[str, float], n: dict[str, int]) -> np.ndarray:
    """Logistic weights for soft labels, the bias last: Newton steps, halved where the loss would rise, until they gain nothing."""
    total = sum(n[v] for v in posterior)
    mean = sum(n[v] * y for v, y in posterior.items()) / total
    balance, ridge = (0.5 / max(1 - mean, 0.02), 0.5 / max(mean, 0.02)), np.append(np.full(FEATURES, RIDGE * total), 1e-9 * total)
    best, w, step = None, np.zeros(FEATURES + 1), None
    for _ in range(ROUNDS):
        loss, gradient, curvature = _sums(rows, posterior, balance, w)
        loss, gradient = loss + float(ridge @ (w * w)) / 2, gradient + ridge * w
        if best is None or loss < best[0]:
            gain = np.inf if best is None else best[0] - loss
            best = loss, w
            if gain < 1e-4 * loss:
                break
            step = np.linalg.solve(curvature + np.diag(ridge), gradient)
        else:
            step = step / 4
        w = best[1] - step
    return np.round(best[1], 6)  # sums of tasks meet in any order


def train(rows: DataFrame) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior by pattern, and the scorer's weights (the bias last) and threshold, from what was ``observed``."""
    n = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, _, _ = estimate(n)
    if not posterior:
        return posterior, np.zeros(FEATURES + 1), 0.5
    w = _fit(rows, posterior, n)

    def binned(batches):
        counts = np.zeros(GRID + 1, dtype=np.int64)
        for b in batches:
            good = np.array([posterior.get(v, 0.0) > 0.5 for v in b.column("votes").to_pylist()], dtype=bool)
            counts += np.bincount((_chance(_matrix(b)[good] @ w) * GRID).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["at", "n"])

    found = rows.select("votes", "x").mapInArrow(binned, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    if not found:
        return posterior, w, 0.5
    below = np.cumsum([0, *(r["n"] for r in found)])
    return posterior, w, min(0.5, found[int(np.searchsorted(below, (1 - RECALL) * below[-1], side="right")) - 1]["at"] / GRID)


def score(documents: DataFrame) -> DataFrame:
    """doc_id, votes, weak posterior, score and whether to keep, of every row."""
    rows = observed(documents)
    held = documents.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches):
        posterior, w, threshold = held.value
        for b in batches:
            said = b.column("votes").to_pylist()
            some = np.array([bool(s) for s in said], dtype=bool)
            p = np.where(some, _chance(_matrix(b) @ w), 0.0)
            yield beside(b, ["doc_id", "votes"], posterior=([posterior.get(s, 0.0) for s in said], pa.float64()), score=(p, pa.float64()), keep=(some & (p >= threshold), pa.bool_()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, votes string, posterior double, score double, keep boolean")
