"""N-gram Jaccard join by prefix filtering under multiple global orders, with the components of its links.

A document's set holds the hashes of its distinct runs of four words. Equal sets are one class, represented by a
64-bit signature; all else works on classes. A global order sorts tokens by how common they are (from a sketch of
counters over all documents), then by a hash of the order's own. Two sets that are similar enough must share a token
within short prefixes under every order, whatever the sketch says: it only makes prefixes rare. The first order
is indexed: each token's list of classes pairs those whose sizes and positions allow a link. The other filters are
intersected with it before any text moves: parities of the sets' tokens (a bit a cell) bound how far two sets are
apart, and the prefixes under every further order must share a token, too. What is left is verified exactly.

Components need no list of all links. First each list's members are tested against the list's least edited one
(the smallest position of the token); then only members of different components are tested, all of them. For that a
long list is dealt into tiles of ``TILE`` by ``TILE`` members or somewhat more, each pair in one tile, so that a list
that holds a third of all classes is work for many tasks, each in memory of one tile, and parities are compared there.
Long lists first ask only for every member's nearest one in each tile, which joins what belongs together before
all that is left is asked. Tests of texts run
in blocks of classes, each block's texts once, and a block emits no more links than it has classes.

Defined results: null, empty and blank texts have empty sets, linked with nothing; rows that repeat a doc_id are
documents of their own with the same id; a null doc_id is never the smallest unless alone; an empty table gives an empty
one. Identifiers keep all 64 bits beside nulls. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .arrow import beside, texts_of
from .components import components
from .shared import keep, partitions

SHINGLE, PERCENT, ORDERS = 4, 85, 3
SKETCH_BITS, SKETCH_ROW = 20, 1 << 12
#: Postings that a task holds before it hands them on; most pivots tried in a list before the rest is left for later.
HELD, PIVOTS = 1 << 19, 32
#: Least members on either side of a tile of a list, and tiles along a side before tiles grow, to 16 times as much at most;
#: longest list that is looked at whole, among others; pieces that a list is dealt into while lists are sized up.
TILE, TILES, SHORT, SALTS = 256, 64, 64, 16
#: The bitmaps of documents to look at again have a fixed size (2 MB), sent in rows.
BITMAP_BITS, BITMAP_ROW = 24, 1 << 15
_U = np.uint64
_SEEDS = [_U(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1)) for i in range(8)]


def _sets(texts, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, w in kernels.words(texts, kernels.NOT_SPACE):
        with np.errstate(over="ignore"):
            run, doc = w.shingles(shingle)
        yield first, kernels.distinct_sets(run, doc, w.n_docs)


def _signature(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((kernels.mix64(tokens ^ _SEEDS[6]).sum() + _U(len(tokens)) * _SEEDS[7]).astype(np.int64))


def _profiles(documents: DataFrame, shingle: int) -> DataFrame:
    """Size and signature of every document's set, and each task's sketch of token counts, in rows of SKETCH_ROW counters.

    ``row`` hashes identifier and text: what tells the rows of one doc_id apart.
    """

    def run(batches):
        sketch, held, total, kind = np.zeros(1 << SKETCH_BITS, dtype=np.int64), [], 0, None

        def count() -> None:
            nonlocal held, total
            if held:
                np.add(sketch, np.bincount((np.concatenate(held) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)), out=sketch)
            held, total = [], 0

        for b in batches:
            sizes, signatures, kind = [], [], b.schema.field("doc_id").type
            for _, sets in _sets(texts_of(b), shingle):
                sizes += map(len, sets)
                signatures += [_signature(s) if len(s) else None for s in sets]
                held += sets
                total += sum(map(len, sets))
                if total >= HELD:
                    count()
            yield beside(b, ["doc_id", "row"], n=(sizes, pa.int64()), sig=(signatures, pa.int64()), block=([None] * b.num_rows, pa.int32()), counts=([None] * b.num_rows, pa.binary()))
        count()
        rows = sketch.reshape(-1, SKETCH_ROW)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            none = [pa.nulls(len(some), t) for t in (kind, pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.zeros(len(some), dtype=np.int64)), pa.nulls(len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["doc_id", "row", "n", "sig", "block", "counts"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_key().alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row bigint, n bigint, sig bigint, block int, counts binary")


def row_key():
    return F.xxhash64("doc_id", "text")


def _heat(rows: DataFrame, n: int) -> np.ndarray:
    """How common the tokens of each counter are: 0 within the noise, then by doubling. A fixed number of counters."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["block"], b["counts"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, dtype=np.int64)
        yield pd.DataFrame({"block": list(sums), "counts": [x.tobytes() for x in sums.values()]}).astype({"block": "int32"})

    schema = "block int, counts binary"
    partial = rows.select("block", "counts").repartition(n).mapInPandas(add, schema)
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for k, c in partial.repartition(16, "block").mapInPandas(add, schema).collect():
        sketch[k * SKETCH_ROW : (k + 1) * SKETCH_ROW] = np.frombuffer(bytes(c), dtype=np.int64)
    mean = sketch.mean()
    over = (sketch - mean) / (8 * mean**0.5 + 16)
    return np.where(over <= 1, 0, 1 + np.log2(np.maximum(over, 1))).astype(np.uint8)


def ordered(tokens: np.ndarray, heat: np.ndarray, order: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` tokens of a set under an order: sort keys, and hashes of the order's own."""
    with np.errstate(over="ignore"):
        mixed = kernels.mix64(tokens ^ _SEEDS[order])
    key = (heat[(tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << _U(58)) | (mixed >> _U(6))
    at = np.argpartition(key, most - 1)[:most] if most < len(key) else np.arange(len(key))
    at = at[np.argsort(key[at], kind="stable")]
    return key[at], mixed[at]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _needed(n, m, percent: int):
    """Least number of common tokens of linked sets of ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def parity(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls in each of some cells, at least one a token: one bit each."""
    width = max(256, 1 << (len(tokens) - 1).bit_length())
    with np.errstate(over="ignore"):
        cell = (kernels.mix64(tokens ^ _SEEDS[5]) & _U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Parities (in the last axis) of fewer cells: what falls in the halves falls in one."""
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def apart(a: bytes, b: bytes) -> int:
    """At least so many tokens are in one of two sets alone: what both have cancels out. The wider parity is folded."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    least = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, least) ^ _folded(y, least)).sum())


class Parities:
    """Parities of many sets, to be compared with one at a time: those of equal width are rows of one array."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.width = n.astype(np.int64), np.array([len(x) // 8 for x in bits], dtype=np.int64)
        self.place, self.of = np.zeros(len(bits), dtype=np.int64), {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.of[int(w)] = np.frombuffer(b"".join(bits[i] for i in at), dtype=np.uint64).reshape(len(at), int(w))

    def room(self, k: int, x: bytes, at: np.ndarray, percent: int) -> np.ndarray:
        """For a set of ``k`` tokens and the sets ``at``: by how many tokens they are nearer than a link needs at least; negative: no link."""
        m, mine = self.n[at], np.frombuffer(x, dtype=np.uint64)
        need = _needed(k, m, percent)
        out = np.where(need <= np.minimum(k, m), k + m - 2 * need, -1)
        widths = self.width[at]
        for w, rows in self.of.items():
            of = np.flatnonzero((widths == w) & (out >= 0))
            if len(of):
                least = min(w, len(mine))
                out[of] -= np.bitwise_count(_folded(rows[self.place[at[of]]], least) ^ _folded(mine, least)).sum(axis=1, dtype=np.int64)
        return out

    def rooms(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """The same as ``room`` for pairs of sets."""
        k, m = self.n[i], self.n[j]
        need = _needed(k, m, percent)
        out = np.where(need <= np.minimum(k, m), k + m - 2 * need, -1)
        for w, ours in self.of.items():
            for x, theirs in self.of.items():
                of = np.flatnonzero((self.width[i] == w) & (self.width[j] == x) & (out >= 0))
                for at in np.split(of, range(1 << 14, len(of), 1 << 14)):
                    out[at] -= np.bitwise_count(_folded(ours[self.place[i[at]]], min(w, x)) ^ _folded(theirs[self.place[j[at]]], min(w, x))).sum(axis=1, dtype=np.int64)
        return out


def ahead(tokens: np.ndarray, heat: np.ndarray, percent: int) -> bytes:
    """The set's prefixes under all orders but the first, 16 bits a token, each in order: enough to tell most apart."""
    most = prefix_size(len(tokens), percent)
    return b"".join(ordered(tokens, heat, o, most)[1].astype(np.uint16).tobytes() for o in range(1, ORDERS))


def share_ahead(k: int, x: np.ndarray, m: int, y: np.ndarray, percent: int) -> bool:
    """Whether two sets' prefixes, as long as a link of sets of ``k`` and ``m`` tokens asks for, have a token in common under every further order."""
    need = int(_needed(k, m, percent))
    x, y = x.reshape(ORDERS - 1, -1)[:, : k - need + 1], y.reshape(ORDERS - 1, -1)[:, : m - need + 1]
    return all(not set(p.tolist()).isdisjoint(q.tolist()) for p, q in zip(x, y, strict=True))


def _postings(documents: DataFrame, heat, shingle: int, percent: int, n_blocks: int) -> DataFrame:
    """Every class's prefix under the first order, dealt by token and packed: a row for each task (or HELD postings) and block."""

    def run(batches):
        seen, held, total = set(), [], 0
        for b in batches:
            for _, sets in _sets(b["text"], shingle):
                for s in sets:
                    if len(s) and (sig := _signature(s)) not in seen:
                        seen.add(sig)
                        _, h = ordered(s, heat.value, 0, prefix_size(len(s), percent))
                        held.append((h, sig, len(s)))
                        total += len(h)
                if total >= HELD:
                    yield pack(held)
                    held, total = [], 0
        if held:
            yield pack(held)

    def pack(held):
        h = np.concatenate([x[0] for x in held])
        long = np.array([len(x[0]) for x in held])
        sig = np.repeat(np.array([x[1] for x in held], dtype=np.int64), long)
        n = np.repeat(np.array([x[2] for x in held], dtype=np.uint32), long)
        pos = (np.arange(len(h)) - np.repeat(np.cumsum(long) - long, long)).astype(np.uint32)
        block = ((h >> _U(40)) % _U(n_blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        ids, first = np.unique(block[order], return_index=True)
        parts = [[x.tobytes() for x in np.split(y[order], first[1:])] for y in (h.astype(np.uint32), sig, n, pos)]
        return pd.DataFrame({"block": ids, "token": parts[0], "sig": parts[1], "n": parts[2], "pos": parts[3]})

    return documents.select("text").mapInPandas(run, "block int, token binary, sig binary, n binary, pos binary")


def _allowed(n, pos, m, at, percent: int):
    """Whether sizes and positions of a common token leave room for a link."""
    need = _needed(n, m, percent)
    return (pos <= n - need) & (at <= m - need) & (need <= np.minimum(n, m))


def _lists(block: int, token, sig, n, pos, percent: int, n_blocks: int):
    """From one block's postings: members of lists to look at again, and first candidates (a, ids)."""
    order = np.lexsort((sig, token))
    token, sig, n, pos = token[order], sig[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    token, sig, n, pos = token[new], sig[new], n[new], pos[new]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, dtype=np.int64)
    long = np.diff(np.append(first, len(token)))
    members, pairs = [], []
    two = first[long == 2]
    two = two[_allowed(n[two], pos[two], n[two + 1], pos[two + 1], percent)]
    if len(two):
        pairs.append(np.stack((sig[two], sig[two + 1]), axis=1))
    for i, k in zip(first[long > 2], long[long > 2], strict=True):
        s, m, p = sig[i : i + k], n[i : i + k], pos[i : i + k]
        rest, found = np.lexsort((s, p)), False
        for _ in range(PIVOTS):
            if len(rest) < 2:
                break
            pivot, others = rest[0], rest[1:]
            ok = _allowed(m[pivot], p[pivot], m[others], p[others], percent)
            if ok.any():
                found = True
                pairs.append(np.stack((np.full(int(ok.sum()), s[pivot]), s[others[ok]]), axis=1))
            rest = others[~ok]
        if found or len(rest) > 1:
            members.append((np.full(k, (block << 32) | int(token[i]), dtype=np.int64), s, m, p))
    return members, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)


def _by_block(a: np.ndarray, b: np.ndarray, n_blocks: int) -> pd.DataFrame:
    """Candidates (a, b) as rows (a, block of b, ids)."""
    block = (b.view(np.uint64) % _U(n_blocks)).astype(np.int32)
    order = np.lexsort((b, block, a))
    a, b, block = a[order], b[order], block[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (block[1:] != block[:-1])))) if len(a) else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"a": a[first], "at": block[first], "ids": pd.Series(np.split(b, first[1:]) if len(a) else [], dtype=object)})


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of fixed number, set at the hashes of ``keys`` (one column): what is not among them is mostly told by one look."""

    def told(bits: np.ndarray) -> pd.DataFrame:
        rows = bits.reshape(-1, BITMAP_ROW)
        some = np.flatnonzero(rows.any(axis=1))
        return pd.DataFrame({"block": some.astype(np.int32), "bits": [rows[i].tobytes() for i in some]})

    def mark(batches):
        bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for b in batches:
            bits[b["h"].to_numpy()] = True
        yield told(np.packbits(bits))

    def either(batches):
        bits = np.zeros((1 << BITMAP_BITS - 3) // BITMAP_ROW * BITMAP_ROW, dtype=np.uint8).reshape(-1, BITMAP_ROW)
        for b in batches:
            for k, x in zip(b["block"], b["bits"], strict=True):
                bits[k] |= np.frombuffer(x, dtype=np.uint8)
        yield told(bits)

    schema = "block int, bits binary"
    marked = keys.select(_hashed(keys.columns[0]).alias("h")).mapInPandas(mark, schema).repartition(min(n, 16), "block").mapInPandas(either, schema)
    out = np.zeros(((1 << BITMAP_BITS - 3) // BITMAP_ROW, BITMAP_ROW), dtype=np.uint8)
    for k, x in marked.collect():
        out[k] |= np.frombuffer(bytes(x), dtype=np.uint8)
    return out.reshape(-1)


def _hashed(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))


def _marks(rows: DataFrame) -> DataFrame:
    """The same as a table (word, bits), for ``rows`` by ``row``: 64 bits a word, so at most 1 << BITMAP_BITS - 6 words however many rows there are."""
    hashed = rows.select(_hashed("row").alias("h"))
    return hashed.groupBy(F.shiftright("h", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))


def _of_classes(wanted: DataFrame, documents: DataFrame, classes: DataFrame, shingle: int, n: int, columns: str, make) -> DataFrame:
    """One row for each class in ``wanted`` (sig): ``make`` of its set and text.

    A bitmap of the classes' first documents spares hashing most others; the join on the signature is exact.
    """
    wanted = keep(wanted.distinct().join(classes, "sig").select("sig", "first"), "wanted")
    held = documents.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("first"), n))

    def run(batches):
        for b in batches:
            at = b.column("h").to_numpy()
            b = b.filter(pa.array((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            texts, rows = texts_of(b), []
            for first, sets in _sets(texts, shingle):
                rows += [(_signature(s), *make(s, texts[first + i])) for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    names, kinds = zip(*(c.split() for c in f"sig bigint, {columns}".split(", ")), strict=True)
    types = [{"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k] for k in kinds]
    found = documents.select(_hashed("doc_id").alias("h"), "text").mapInArrow(run, f"sig bigint, {columns}")
    return found.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def _dealt(candidates: DataFrame, rows: DataFrame, n_blocks: int):
    """``candidates`` (a, at, ids) with the row of ``a``, and ``rows`` (sig, ...) by block, to be brought together by block.

    Both sides join ``rows`` by its own ``sig`` and columns, so that one shuffle of them serves both.
    """
    asked = candidates.join(rows, F.col("a") == F.col("sig")).select(*candidates.columns, *(F.col(c).alias(c) for c in rows.columns[1:]))
    unsigned = F.pmod(F.col("sig"), F.lit(n_blocks)) + F.when(F.col("sig") < 0, F.lit((1 << 64) % n_blocks)).otherwise(F.lit(0))
    there = rows.join(candidates.select(F.explode("ids").alias("sig")).distinct(), "sig", "left_semi").withColumn("at", F.pmod(unsigned, F.lit(n_blocks)).cast("int"))
    return asked.groupBy("at").cogroup(there.groupBy("at"))


class _Run:
    """What all steps of one join have in common."""

    def __init__(self, documents: DataFrame, classes: DataFrame, heat, shingle: int, percent: int, n: int):
        self.documents, self.classes, self.heat, self.shingle, self.percent, self.n, self.n_blocks = documents, classes, heat, shingle, percent, n, 4 * n
        self.seen: DataFrame | None = None

    def of_classes(self, wanted: DataFrame, columns: str, make) -> DataFrame:
        return _of_classes(wanted, self.documents, self.classes, self.shingle, self.n, columns, make)

    def look(self, wanted: DataFrame) -> None:
        """Sizes, parities and further prefixes of the classes in ``wanted`` (sig)."""
        heat, percent = self.heat, self.percent
        self.seen = keep(self.of_classes(wanted, "n bigint, bits binary, ahead binary", lambda s, _: (len(s), parity(s), ahead(s, heat.value, percent))), "seen")

    def links(self, candidates: DataFrame) -> DataFrame:
        """Links (a, b) among ``candidates`` (a, at, ids): in each block enough of them to connect what is connected there."""
        candidates = keep(candidates.groupBy("a", "at").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")), "candidates")
        left = keep(_dealt(candidates, self.seen, self.n_blocks).applyInPandas(_nearer(self.percent), "a bigint, at int, ids array<bigint>"), "near")
        texts = keep(self.of_classes(left.select(F.col("a").alias("sig")).union(left.select(F.explode("ids"))), "text string", lambda _, text: (text,)), "texts")
        return keep(_dealt(left, texts, self.n_blocks).applyInPandas(_verified(self.shingle, self.percent), "a bigint, b bigint"), "links")


def _nearer(percent: int):
    """Keeps the candidates that neither parities nor the prefixes under a further order exclude."""

    def near(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        place, rows = {k: i for i, k in enumerate(there["sig"])}, []
        held = Parities(there["n"].to_numpy(), list(there["bits"]))
        theirs = [np.frombuffer(x, dtype=np.uint16) for x in there["ahead"]]
        for a, at, k, ids, bits, mine in zip(asked["a"], asked["at"], asked["n"], asked["ids"], asked["bits"], asked["ahead"], strict=True):
            j = np.array([place[b] for b in ids], dtype=np.int64)
            mine = np.frombuffer(mine, dtype=np.uint16)
            left = [ids[i] for i in np.flatnonzero(held.room(k, bits, j, percent) >= 0) if share_ahead(k, mine, int(held.n[j[i]]), theirs[j[i]], percent)]
            if left:
                rows.append((a, at, left))
        return pd.DataFrame(rows, columns=["a", "at", "ids"])

    return near


def _verified(shingle: int, percent: int):
    """Links among the candidates of a block: the sets' intersection decides; what is connected already is not asked again."""

    def verify(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        ours = dict(zip(there["sig"], (s for _, sets in _sets(there["text"], shingle) for s in sets), strict=True))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        links, at = [], 0
        for _, sets in _sets(asked["text"], shingle):
            for s in sets:
                a = asked["a"].iat[at]
                for b in map(int, asked["ids"].iat[at]):
                    if root(a) == root(b):
                        continue
                    t = ours[b]
                    small, large = (s, t) if len(s) <= len(t) else (t, s)
                    where = np.searchsorted(large, small)
                    where[where == len(large)] = 0
                    both = int((large[where] == small).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        links.append((a, b))
                        parent[root(a)] = root(b)
                at += 1
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return verify


def _across(members: DataFrame, labels: DataFrame, run: _Run, nearest: bool) -> DataFrame:
    """Candidates (a, at, ids) of different labels in one list of ``members`` (list, sig, n, pos), asked from outside its most common label.

    ``nearest``: of lists of more than ``TILE`` members only, and for each member only the nearest one in each tile.
    """
    n, n_blocks, percent = run.n, run.n_blocks, run.percent
    labelled = keep(members.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig")).withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS))), "labelled")
    by_label = labelled.groupBy("list", "label").agg(F.count("*").alias("c"))
    lists = by_label.groupBy("list").agg(F.sum("c").alias("k"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    if nearest:
        lists = lists.filter(F.col("k") > TILE)
    side = lambda k: F.greatest(F.least(F.ceil(k / TILE), F.lit(TILES)), F.ceil(k / (16 * TILE)))
    sides = lists.select("list", "k", F.col("top.label").alias("top"), side(F.col("k")).alias("g"), side(F.col("k") - F.col("top.c")).alias("h"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    mixed = labelled.join(sides, ["list", "salt"]).withColumn("outside", F.col("label") != F.col("top"))
    place = lambda seed, of: F.pmod(F.xxhash64("sig", F.lit(seed)), F.col(of))
    row = lambda i, j, asking: F.struct(i.alias("i"), j.alias("j"), F.lit(asking).alias("asking"))
    there = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1), lambda i: row(i, place(1, "g"), False))
    asking = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1), lambda j: row(place(2, "h"), j, True))
    mixed = mixed.select("list", "k", "g", "h", "sig", "n", "pos", "label", "outside").join(run.seen.select("sig", "bits"), "sig")
    dealt = mixed.filter(F.col("k") > SHORT).withColumn("at", F.explode(F.when(F.col("outside"), F.concat(there, asking)).otherwise(there))).select("list", "at.*", "sig", "n", "pos", "label", "outside", "bits")

    def judged(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        asking = tile["asking"].to_numpy(dtype=bool)
        ask, sig, m, p, label, outside, bits = tile[asking], *(tile[c].to_numpy()[~asking] for c in ("sig", "n", "pos", "label", "outside")), list(tile["bits"][~asking])
        held, out = Parities(m, bits) if len(ask) and len(bits) else None, []
        for a, k, q, mine, x in zip(ask["sig"], ask["n"], ask["pos"], ask["label"], ask["bits"], strict=True) if held else ():
            at = np.flatnonzero(_allowed(k, q, m, p, percent) & (label != mine) & (~outside.astype(bool) | (sig > a) if not nearest else sig != a))
            room = held.room(k, x, at, percent) if len(at) else at
            at, room = at[room >= 0], room[room >= 0]
            if nearest and len(at):
                at = at[room.argmax()][None]
            out.append((np.full(len(at), a), sig[at]))
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in (0, 1))

    def short(batches):
        kept = None
        for b in batches:
            frame = b.to_pandas()
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            last = int(np.searchsorted(frame["list"].to_numpy(), frame["list"].iloc[-1])) if len(frame) else 0
            yield told([pairs_of(frame.iloc[:last])])
            kept = frame.iloc[last:]
        if kept is not None:
            yield told([pairs_of(kept)])

    def pairs_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of whole short lists, in order of list."""
        of, sig, m, p, label, outside = (frame[c].to_numpy() for c in ("list", "sig", "n", "pos", "label", "outside"))
        held = Parities(m, list(frame["bits"]))
        asking = np.flatnonzero(outside.astype(bool))
        first, long = np.searchsorted(of, of[asking]), np.searchsorted(of, of[asking], side="right")
        long -= first
        a = np.repeat(asking, long)
        b = np.arange(len(a)) + np.repeat(first - np.cumsum(long) + long, long)
        ok = (label[a] != label[b]) & (~outside[b].astype(bool) | (sig[b] > sig[a])) & _allowed(m[a], p[a], m[b], p[b], percent)
        a, b = a[ok], b[ok]
        near = held.rooms(a, b, percent) >= 0
        return sig[a[near]], sig[b[near]]

    def tiles(batches):
        kept, pairs, total = None, [], 0
        for b in batches:
            frame = b.to_pandas()
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            new = (frame[["list", "i", "j"]].diff() != 0).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            for start, end in zip(starts, starts[1:], strict=False):
                pairs.append(judged(frame.iloc[start:end]))
                total += len(pairs[-1][0])
                if total >= HELD:
                    yield told(pairs)
                    pairs, total = [], 0
            kept = frame.iloc[starts[-1] :] if len(starts) else kept
        if kept is not None:
            yield told([*pairs, judged(kept)])

    def told(pairs) -> pa.RecordBatch:
        found = np.unique(np.stack([np.concatenate([x[i] for x in pairs]) for i in (0, 1)], axis=1), axis=0)
        frame = _by_block(found[:, 0], found[:, 1], n_blocks)
        return pa.RecordBatch.from_arrays([pa.array(frame["a"], pa.int64()), pa.array(frame["at"], pa.int32()), pa.array(list(frame["ids"]), pa.list_(pa.int64()))], names=["a", "at", "ids"])

    schema = "a bigint, at int, ids array<bigint>"
    out = dealt.repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(tiles, schema)
    if nearest:
        return out
    whole = mixed.filter(F.col("k") <= SHORT).select("list", "sig", "n", "pos", "label", "outside", "bits").repartition(n, "list").sortWithinPartitions("list")
    return out.union(whole.mapInArrow(short, schema))


def _resolved(documents: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n, sig), and classes (sig, first, label): equal labels are linked, directly or through others."""
    spark = documents.sparkSession
    n = partitions(spark)
    n_blocks = 4 * n
    profiles = keep(_profiles(documents, shingle), "profiles")
    sized = profiles.filter("block IS NULL").select("doc_id", "row", "n", "sig")
    heat = spark.sparkContext.broadcast(_heat(profiles.filter("block IS NOT NULL"), n))
    classes = keep(sized.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first")), "classes")

    def to_lists(key, group: pd.DataFrame) -> pd.DataFrame:
        columns = [np.concatenate([np.frombuffer(x, dtype=t) for x in group[c]]) for c, t in (("token", np.uint32), ("sig", np.int64), ("n", np.uint32), ("pos", np.uint32))]
        members, pairs = _lists(int(key[0]), *columns, percent, n_blocks)
        out = [_by_block(pairs[:, 0], pairs[:, 1], n_blocks)]
        if members:
            out.append(pd.DataFrame({c: np.concatenate([m[i] for m in members]) for i, c in enumerate(("list", "sig", "n", "pos"))}))
        kinds = {"list": "Int64", "sig": "Int64", "n": "Int64", "pos": "Int64", "a": "Int64", "at": "Int32", "ids": "object"}
        return pd.concat([pd.DataFrame({c: x[c].astype(k) if c in x else pd.Series([None] * len(x), dtype=k) for c, k in kinds.items()}) for x in out], ignore_index=True)

    schema = "list bigint, sig bigint, n bigint, pos bigint, a bigint, at int, ids array<bigint>"
    found = keep(_postings(documents, heat, shingle, percent, n_blocks).groupBy("block").applyInPandas(to_lists, schema), "lists")
    members, pairs = found.filter("list IS NOT NULL").select("list", "sig", "n", "pos"), found.filter("a IS NOT NULL").select("a", "at", "ids")
    run = _Run(documents, classes, heat, shingle, percent, n)
    run.look(members.select("sig").union(pairs.select("a")).union(pairs.select(F.explode("ids"))))
    links = run.links(pairs)
    labels = components(links)
    for nearest in (True, False):
        more = keep(_across(members, labels, run, nearest), "asked")
        if more.take(1):
            links = links.union(run.links(more))
            labels = components(links)
    return sized, classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def join(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id of an equal set) of every row."""
    sized, known = _resolved(documents, shingle, percent)
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = known.join(smallest, "label").select("sig", F.col("first").alias("class_id"), "component_id")
    return (
        sized.join(of_class, "sig", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    )


def keep_one_of_each(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``documents`` with one row of each group of linked ones: that of the smallest doc_id, null last; of several such, by hash of the text.

    Rows are told apart by identifier and text: other texts under the same doc_id stay if they are linked with nothing,
    and of rows alike in both one stays. Rows without a word are linked with nothing, so all of them stay.

    A bitmap of the rows to judge lets most others pass where they are read; only what it marks is shuffled, text and all,
    and the join there is exact.
    """
    sized, known = _resolved(documents, shingle, percent)
    rows = keep(sized.filter("sig IS NOT NULL").groupBy("doc_id", "row", "sig").agg(F.count("*").alias("c")).join(known.select("sig", "label"), "sig").select("doc_id", "row", "label", "c"), "rows")
    one = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("one")).select("label", F.col("one.doc_id").alias("one_id"), F.col("one.row").alias("one_row"))
    one = one.withColumnRenamed("label", "of")
    chosen = (rows["label"] == one["of"]) & rows["doc_id"].eqNullSafe(one["one_id"]) & (rows["row"] == one["one_row"])  # by all three: a label alone may be a third of all rows
    judged = rows.join(one, chosen, "left").withColumn("stays", F.col("one_row").isNotNull())
    judged = keep(judged.filter("NOT stays OR c > 1").select(F.col("doc_id").alias("id"), "row", "stays"), "judged")
    whole = documents.select(F.struct("*").alias("it"), F.col("doc_id").alias("id"), row_key().alias("row"))
    whole = whole.join(F.broadcast(_marks(judged)), F.shiftright(_hashed("row"), 6) == F.col("word"), "left").withColumn("marked", F.coalesce(F.getbit("bits", F.pmod(_hashed("row"), F.lit(64)).cast("int")) == 1, F.lit(False)))
    asked = whole.filter("marked")

    def among(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        of = of.select(F.col("id").alias("id_"), F.col("row").alias("row_"))
        return rows.join(of, (rows["row"] == of["row_"]) & rows["id"].eqNullSafe(of["id_"]), how)

    out = whole.filter("NOT marked").select("it.*").unionAll(among(asked, judged, "left_anti").select("it.*"))
    repeated = judged.filter("stays")
    if repeated.take(1):
        out = out.unionAll(among(asked, repeated, "left_semi").groupBy("id", "row").agg(F.min_by("it", F.hash("it")).alias("it")).select("it.*"))
    return out


JOIN_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from s group by doc_id
), c as (
  select n, h, min(doc_id) as first from n group by n, h
), r as (
  select s.doc_id, s.g from s join c on s.doc_id = c.first
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from r a join r b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), l as (
  select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)
), t as (
  select first as a, first as b from c union select t.a, l.b from t join l on t.b = l.a
), m as (select a, min(b) as component from t group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component, d.doc_id) as component_id, coalesce(c.first, d.doc_id) as class_id
from d left join n on d.doc_id = n.doc_id left join c on n.n = c.n and n.h = c.h left join m on c.first = m.a
"""
