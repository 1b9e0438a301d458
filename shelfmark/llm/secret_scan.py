"""Secret scanning: a character convolutional network in numpy judges every candidate with its surrounding context.

Base findings come from three fixed patterns and always stay. Candidates are the base findings' values and every other
token of at least ``LEAST`` characters that holds a digit or changes case inside. Each candidate is shown to the
network in windows of ``VALUE`` characters, ``STEP`` apart until its end, with ``CONTEXT`` characters on either side; its
score is the highest of its windows. The network (character classes, one convolution, maximum over places, one hidden
layer) is trained here on all labelled candidates of the corpus, each distinct one once: positive where a base
pattern names them a secret and negative for plain tokens, enlarged by ``SYNTHETIC`` seeded secrets and look-alikes, so that both
labels always exist. Tokens that look random but that no pattern names have no label and train nothing.

Windows are dealt by hash into groups of about ``GROUP``. In each of ``ROUNDS`` rounds every group, with all synthetic
windows beside its own, learns for some epochs from the weights that all share; the next round starts from their mean. Scores are
calibrated by Platt scaling on a fifth of the candidates kept aside, and the threshold is the highest that keeps ``RECALL`` of that
fifth's secrets, and of those among them that the corpus itself holds; both come from counts of outputs, rounded down to
``1 / FINE``. Candidates at or above it that overlap no base finding become findings of kind ``token``.

Defined results: null text is empty and has no findings; rows that repeat a doc_id are each scanned; an empty table
gives an empty one. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import beside, replaced, texts_of
from .kernels import apart_from
from .shared import keep

# The base patterns and the least length of a finding.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "token")

LEAST, VALUE, CONTEXT, STEP = 16, 40, 24, 10
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SYNTHETIC, GROUP, RECALL, SEED, EPOCHS, ROUNDS, FINE = 4000, 4000, 0.98, 7, 12, 4, 64
WIDTH = VALUE + 2 * CONTEXT
WORD, VOWEL, CLUSTER = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}"), re.compile(r"[aeiouy]", re.IGNORECASE), re.compile(r"[^aeiouy]{5}", re.IGNORECASE)
N_CLASS, FILTERS, SPAN, HIDDEN = 16, 24, 5, 16


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of ``KINDS``; offsets in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens that may be secrets: long enough, with a digit or a change of case after the first letter."""
    out = []
    for m in TOKEN.finditer(text):
        x = m.group()
        if any(c.isdigit() for c in x) or not (x[1:].islower() or x.isupper() or x[1:].upper() == x[1:]):
            out.append(m.span())
    return out


def _class_table() -> np.ndarray:
    """Character classes: 0 padding, then lower vowels, lower consonants, a-f and so on; one class for all beyond ASCII."""
    t = np.full(129, 15, dtype=np.int8)
    for c in range(128):
        x = chr(c)
        t[c] = (
            1 if x in "aeiou" else 2 if x in "bcdf" else 3 if x.islower() else 4 if x in "ABCDEF" else 5 if x.isupper() else 6 if x.isdigit()
            else 7 if x == " " else 8 if x in "\n\r\t" else 9 if x in "=:" else 10 if x in "\"'" else 11 if x in "+/" else 12 if x in "_-" else 13 if x in ".," else 14
        )
    return t


_CLASS = _class_table()


def looks_random(token: str) -> bool:
    """Whether a token may be an unlabelled secret: many different characters, less than half of them in words or separators."""
    if not any(c.isalpha() for c in token):
        return False
    n = len(token)
    entropy = -sum(k / n * log2(k / n) for k in Counter(token).values())
    worded = sum(c in "/_=-" for c in token) + sum(len(x) for x in WORD.findall(token) if VOWEL.search(x) and not CLUSTER.search(x))
    return entropy >= 3 and 2 * worded < n


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """Where the windows on a value lie: all of it, in runs of at most ``VALUE`` characters that overlap."""
    return [(a, b)] if b - a <= VALUE else [*((i, i + VALUE) for i in range(a, b - VALUE, STEP)), (b - VALUE, b)]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character classes around each span of at most ``VALUE`` characters: context, value, context."""
    out = np.zeros((len(spans), WIDTH), dtype=np.int8)
    for row, (a, b) in zip(out, spans, strict=True):
        left = text[max(0, a - CONTEXT) : a]
        for at, piece in ((CONTEXT - len(left), left), (CONTEXT, text[a:b]), (CONTEXT + VALUE, text[b : b + CONTEXT])):
            if piece:
                row[at : at + len(piece)] = _CLASS[np.minimum(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]
    return out


def platt(raw: np.ndarray, truth: np.ndarray, rounds: int = 100, n: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and shift of the logistic curve of best likelihood, by Newton steps until they stand still; each output counts ``n`` times.

    Labels count as a little less than sure, by one observation on either side, so that separable scores have a finite scale, too.
    """
    n = np.ones(len(raw)) if n is None else n
    n1 = n @ truth
    goal = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (n.sum() - n1 + 2))
    x, w = np.stack((raw, np.ones(len(raw))), axis=1), np.array([1.0, 0.0])
    loss = lambda w: float(n @ (np.logaddexp(0, x @ w) - goal * (x @ w)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (n * (p - goal)))
        while loss(w - step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


class Network:
    """Embedding by class, convolution, maximum over places, one hidden layer, one output; trained by Adam in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dims = {"w": (SPAN * N_CLASS, FILTERS), "b": (FILTERS,), "v": (2 * FILTERS, HIDDEN), "c": (HIDDEN,), "u": (HIDDEN,), "d": ()}
        self.p = {k: (rng.normal(size=s) * (2 / s[0]) ** 0.5 if len(s) else np.zeros(s)) if k in "wvu" else np.zeros(s) for k, s in dims.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.measured: dict[str, tuple[float, float, int]] = {}

    def _forward(self, x: np.ndarray):
        w = self.p["w"].reshape(SPAN, N_CLASS, FILTERS)
        places = WIDTH - SPAN + 1
        conv = self.p["b"] + sum(w[j][x[:, j : j + places]] for j in range(SPAN))
        inside = slice(CONTEXT - SPAN // 2, CONTEXT + VALUE - SPAN // 2)
        top, mean = conv.argmax(axis=1), np.maximum(conv[:, inside], 0).mean(axis=1)
        pooled = np.concatenate((np.maximum(np.take_along_axis(conv, top[:, None], 1)[:, 0], 0), mean), axis=1)
        hidden = np.maximum(pooled @ self.p["v"] + self.p["c"], 0)
        return conv, top, inside, pooled, hidden, hidden @ self.p["u"] + self.p["d"]

    def copy(self) -> Network:
        other = Network()
        other.p = {k: v.copy() for k, v in self.p.items()}
        return other

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, owner: np.ndarray | None = None, corpus: int | None = None, epochs: int = EPOCHS) -> Network:
        """Learn from windows ``x`` of labels ``y``; windows of one ``owner``, a number from 0, show one candidate.

        Owners from ``corpus`` on are findings of the corpus. The threshold keeps ``RECALL`` of all secrets set aside, and of
        the corpus's own. ``measured`` holds recall and precision on what was set aside: of all, and of the corpus's own.
        """
        rng = np.random.default_rng(SEED)
        owner = np.arange(len(y)) if owner is None else owner
        apart = rng.random(int(owner.max()) + 1) < 0.2
        for label in (0, 1):  # both labels on either side
            of = owner[y == label]
            apart[of[0]], apart[of[-1]] = True, False
        aside = apart[owner]
        self._descend(x[~aside], y[~aside], epochs, rng)
        raw, top, label = self.raw(x[aside]), np.full(len(apart), -np.inf), np.zeros(len(apart))
        np.maximum.at(top, owner[aside], raw)
        label[owner[aside]] = y[aside]
        own = np.arange(len(apart)) >= (len(apart) if corpus is None else corpus)
        return self.calibrate(raw, y[aside], np.ones(len(raw)), top[apart], label[apart], own[apart], np.ones(int(apart.sum())))

    def calibrate(self, raw, truth, n, top, label, own, m) -> Network:
        """From what was kept aside: outputs ``raw`` of windows with their labels, ``n`` of each; highest outputs ``top`` of candidates, whether they are the corpus's ``own``, ``m`` of each."""
        self.scale, self.shift = platt(raw, truth, n=n)
        score, limits = 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -30, 30))), []
        for some in (label == 1, (label == 1) & own):
            if some.any():
                order = np.argsort(score[some])
                count = np.cumsum(m[some][order])
                limits.append(float(score[some][order][np.searchsorted(count, int((1 - RECALL) * count[-1]), side="right")]))
        self.threshold = min(limits)
        for name, some in (("all", np.ones(len(top), dtype=bool)), ("corpus", own)):
            hit, said = m @ (some & (label == 1)), m @ (some & (score >= self.threshold))
            both = m @ (some & (label == 1) & (score >= self.threshold))
            self.measured[name] = (float(both / max(hit, 1)), float(both / max(said, 1)), int(m @ some))
        return self

    def _descend(self, x, y, epochs, rng) -> None:
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 64):
                some = order[i : i + 64]
                for k, g in self._gradient(x[some], y[some]).items():
                    t += k == "w"
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def _gradient(self, x, y) -> dict[str, np.ndarray]:
        conv, top, inside, pooled, hidden, out = self._forward(x)
        d_out = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
        d_hidden = np.outer(d_out, self.p["u"]) * (hidden > 0)
        d_pooled = d_hidden @ self.p["v"].T
        d_conv = np.zeros_like(conv)
        d_conv[:, inside] = d_pooled[:, None, FILTERS:] * (conv[:, inside] > 0) / (inside.stop - inside.start)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        d_conv[rows, top, cols] += d_pooled[:, :FILTERS] * (pooled[:, :FILTERS] > 0)
        d_w, places = np.zeros((SPAN, N_CLASS, FILTERS)), conv.shape[1]
        flat = d_conv.reshape(-1, FILTERS)
        for j in range(SPAN):
            one = np.eye(N_CLASS)[x[:, j : j + places].reshape(-1)]
            d_w[j] = one.T @ flat
        return {"w": d_w.reshape(-1, FILTERS), "b": flat.sum(0), "v": pooled.T @ d_hidden, "c": d_hidden.sum(0), "u": hidden.T @ d_out, "d": d_out.sum()}


def _synthetic(rng: np.random.Generator, n: int) -> tuple[list[tuple[str, tuple[int, int]]], list[int]]:
    """Seeded secrets and look-alikes in their contexts."""
    mixed, hexa, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    word = lambda: "".join(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or")[i] for i in rng.integers(0, 15, rng.integers(1, 6)))
    shown, labels = [], []
    for i in range(n):
        before, after = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(6))
        kind, k = i % 8, int(rng.integers(16, 48))
        if kind < 4:
            value = (pick(mixed, k), pick(hexa, k), "AKIA" + pick(mixed[:26] + mixed[52:], 16), pick(mixed + "+/_-", k))[kind]
            lead = ("", 'token = "', "password: ", "secret=", "api_key='", "Authorization: Bearer ")[int(rng.integers(0, 6))]
        else:
            value = ("-".join(word() for _ in range(6)), pick("0123456789", k), f"{word()}_{word()}_{word()}_{rng.integers(1, 99)}_{word()}", (word() * 5).title() + word() * 3)[kind - 4]
            value = value if len(value) >= LEAST else value + lower[:LEAST]
            lead = ("", "see ", "/", "id ", "no. ", "(")[int(rng.integers(0, 6))]
        text = f"{before} {lead}{value}{'\"' if lead.endswith('\"') else ''} {after}"
        at = len(before) + 1 + len(lead)
        shown.append((text, (at, at + len(value))))
        labels.append(int(kind < 4))
    return shown, labels


def labels_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of the candidates of a text that have a label: 1 where a pattern names a secret, 0 for plain tokens."""
    base = [(m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] + [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    taken = base + [m.span() for m in HEX.finditer(text)]
    plain = [s for s in apart_from(candidates(text), taken) if not looks_random(text[slice(*s)])]
    return [(*s, 1) for s in base] + [(*s, 0) for s in plain]


def labelled(documents: DataFrame) -> DataFrame:
    """The windows of all labelled candidates of the corpus, those of one candidate under one ``owner``; candidates that look alike to the network are one."""

    def find(batches):
        for b in batches:
            rows = []
            for t in b["text"]:
                for a, e, y in labels_of(t):
                    x = windows(t, pieces(a, e))
                    owner = int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), signed=True)
                    rows += [(owner, w.tobytes(), y) for w in x]
                if len(rows) > 1 << 14:
                    yield pd.DataFrame(rows, columns=["owner", "x", "y"])
                    rows = []
            yield pd.DataFrame(rows, columns=["owner", "x", "y"])

    found = documents.select("text").filter(F.col("text").rlike(r"[A-Za-z0-9+/_.=-]{12,}")).mapInPandas(find, "owner bigint, x binary, y int")
    return found.groupBy("owner", "x").agg(F.max("y").alias("y"))


def _binned(raw: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(raw, -64, 64) * FINE).astype(np.int64)


def _round(rows: DataFrame, groups: int, net: Network, shown: tuple[np.ndarray, np.ndarray], turn: int) -> dict[str, np.ndarray]:
    """Weights after one more round: the mean of what the groups of ``rows`` (g, x, y) learn from ``net``'s, by how many windows they have."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((net, *shown))

    def learn(key, frame: pd.DataFrame) -> pd.DataFrame:
        mine, x, y = held.value
        frame = frame[frame["y"] >= 0].sort_values(["x", "y"])
        mine = mine.copy()
        x = np.concatenate((np.frombuffer(b"".join(frame["x"]), dtype=np.int8).reshape(-1, WIDTH), x))
        mine._descend(x, np.concatenate((frame["y"].to_numpy(dtype=float), y)), EPOCHS // ROUNDS, np.random.default_rng((SEED, turn, int(key[0]))))
        return pd.DataFrame({"w": [np.concatenate([v.ravel() for v in mine.p.values()])], "n": [len(x)]})

    every = spark.range(groups).select(F.col("id").alias("g"), F.lit(b"").alias("x"), F.lit(-1).alias("y"))  # a group without windows learns from synthetic ones
    learnt = rows.select("g", "x", "y").union(every).repartition(groups, "g").groupBy("g").applyInPandas(learn, "w array<double>, n bigint")
    mean = learnt.select("n", F.posexplode("w").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).orderBy("i").collect()
    flat, out, at = np.round([r["w"] for r in mean], 9), {}, 0  # sums meet in any order
    for k, v in net.p.items():
        out[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
    return out


def scan_text(net: Network, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """All findings of each text, base and added, by start, then kind: start, end, kind, score."""
    base, more, seen, first, n = [], [], [], [], 0
    for t in texts:
        found = base_findings(t)
        extra = apart_from(candidates(t), [(a, e) for a, e, _ in found])
        base.append(found)
        more.append(extra)
        some = [pieces(a, e) for a, e in [(a, e) for a, e, _ in found] + extra]
        for x in some:
            first.append(n)
            n += len(x)
        seen.append(windows(t, [s for x in some for s in x]))
    scores = np.maximum.reduceat(net.score(np.concatenate(seen)), first) if first else np.zeros(0)
    out, at = [], 0
    for found, extra in zip(base, more, strict=True):
        mine = scores[at : at + len(found) + len(extra)]
        at += len(mine)
        all_ = [(a, e, k, float(x)) for (a, e, k), x in zip(found, mine, strict=False)]
        all_ += [(a, e, "token", float(x)) for (a, e), x in zip(extra, mine[len(found) :], strict=True) if x >= net.threshold]
        out.append(sorted(all_, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))
    return out


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{e}" for a, e, k in found)


def trained(documents: DataFrame) -> Network:
    """The network after all rounds, calibrated by what was kept aside."""
    spark, net = documents.sparkSession, Network()
    rows = keep(labelled(documents), "labelled")
    groups = max(1, -(-rows.count() // GROUP))
    hashed = lambda of, n, seed: F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(n))
    rows = rows.select("owner", "x", "y", (hashed("owner", 5, 1) == 0).alias("aside"), hashed("x", groups, 2).alias("g"))
    texts, labels = _synthetic(np.random.default_rng(SEED), SYNTHETIC)
    shown, labels = [windows(t, pieces(*s)) for t, s in texts], np.array(labels, dtype=float)
    apart = np.random.default_rng(SEED).random(len(shown)) < 0.2
    owner = np.repeat(np.arange(len(shown)), [len(x) for x in shown])
    x, aside = np.concatenate(shown), apart[owner]
    for turn in range(ROUNDS):
        net.p = _round(rows.filter("NOT aside"), groups, net, (x[~aside], labels[owner][~aside]), turn)
    held = spark.sparkContext.broadcast(net)

    def judge(batches):
        for b in batches:
            raw = held.value.raw(np.frombuffer(b"".join(b["x"]), dtype=np.int8).reshape(-1, WIDTH))
            yield pd.DataFrame({"owner": b["owner"], "at": _binned(raw), "y": b["y"]})

    judged = rows.filter("aside").select("owner", "x", "y").mapInPandas(judge, "owner bigint, at bigint, y int")
    tops = judged.groupBy("owner").agg(F.max("at").alias("at"), F.max("y").alias("y"))
    counts = [np.array([tuple(r) for r in df.groupBy("at", "y").agg(F.count("*")).collect()], dtype=float).reshape(-1, 3) for df in (judged, tops)]
    raw = _binned(net.raw(x[aside]))
    top = np.full(len(shown), -64 * FINE)
    np.maximum.at(top, owner[aside], raw)
    one = lambda at, y: np.stack((at, y, np.ones(len(y))), axis=1)
    seen = np.concatenate((one(raw, labels[owner][aside]), counts[0]))
    told = np.concatenate((one(top[apart], labels[apart]), counts[1]))
    own = np.arange(len(told)) >= apart.sum()
    return net.calibrate(seen[:, 0] / FINE, seen[:, 1], seen[:, 2], told[:, 0] / FINE, told[:, 1], own, told[:, 2])


def scan(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, counts and digest of the base findings, all ``spans``, and the highest score of each row."""
    held = documents.sparkSession.sparkContext.broadcast(net or trained(documents))
    told = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "top_score": pa.float64()}

    def run(batches):
        for b in batches:
            rows = []
            for found in scan_text(held.value, [t or "" for t in texts_of(b)]):
                base = [(a, e, k) for a, e, k, _ in found if k != "token"]
                n = [sum(k == x for _, _, k in base) for x in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined((a, e, k) for a, e, k, _ in found), max([0.0, *(x for *_, x in found)])))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield beside(b, ["doc_id"], **{name: (values, kind) for (name, kind), values in zip(told.items(), columns, strict=True)})

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, top_score double"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def redact(documents: DataFrame, net: Network | None = None, mark: str = "[{kind}]") -> DataFrame:
    """``documents`` with every finding replaced by ``mark``; overlapping findings become one, named by the first."""
    held = documents.sparkSession.sparkContext.broadcast(net or trained(documents))

    def run(batches):
        for b in batches:
            texts = texts_of(b)
            for i, found in enumerate(scan_text(held.value, [t or "" for t in texts])):
                if found:
                    out, at = [], 0
                    for a, e, kind, _ in found:
                        if a >= at:
                            out += [texts[i][at:a], mark.format(kind=kind)]
                        at = max(at, e)
                    texts[i] = "".join([*out, texts[i][at:]])
            yield replaced(b, "text", texts)

    return documents.mapInArrow(run, documents.schema)
