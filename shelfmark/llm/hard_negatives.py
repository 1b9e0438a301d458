"""Hard-negative mining: for anchors and their positives, the best rows of other labels inside a window of scores.

Anchors are a stated query set, compared with all rows. They are cut into blocks of bounded size, and a block is
broadcast to tasks that stream over the rows; no pair of rows is stored. What a window asks for is found by radix
selection: every task counts the scores of its rows inside each window by the leading digit of their distance from the
window's top, a grouped shuffle adds the counts up, and the bucket that holds the kth score is located. Only that bucket
is cut again by the next digit, first of the score and, where one score ties too many rows, of the identifier. A last pass
gathers the rows at or above what was located, and ranks them. Positives are found in the same way, in windows over all
scores of the own label.

A task sends, for each window, only the buckets up to the one that holds its own kth row (the kth of all cannot lie
beyond), and gathers at most k rows: what is shuffled follows tasks and windows, never the rows that tie or qualify. The
driver holds one block's windows: BLOCK anchors times the positives of each.

Defined results: rows whose label or vector is null, or whose vector holds a null or non-finite component, take no part;
an empty table gives an empty one; rows that repeat are rows of their own, so a repeated anchor is answered as often, and
has its copies among its positives; a row without identifier is no anchor and comes last among equal scores. Vectors of
unequal length are filled up with zeros; a scaled component beyond ``vectors.room`` is taken as that bound. Columns other
than the three asked for are left alone, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir
from .vectors import SLICE, integers, room, slices, whole

EVERY, POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 50, 5, 3, 50, 95, 256
#: Anchors of a block at most, and components of its vectors at most; bits of a digit; rows up to which a bucket is gathered; scores a task holds.
BLOCK, BLOCK_COMPONENTS, DIGIT, GATHER, SCORES = 4096, 1 << 22, 8, 64, 1 << 20
_LAST_ID = np.uint64(2**64 - 1)


@dataclass
class Asked:
    """Windows over a block of anchors, by anchor. A window asks for the first ``k`` rows from score ``top`` down to ``low``.

    ``high``, ``low`` and ``first``, ``last`` bound the scores and, for a single score, identifiers in which the last row
    asked for lies; ``need`` of those are asked for. ``open`` is true while that interval is to be cut again. ``mark`` is the
    window's number among those begun with.
    """

    mark: np.ndarray
    anchor: np.ndarray
    top: np.ndarray
    high: np.ndarray
    low: np.ndarray
    first: np.ndarray
    last: np.ndarray
    need: np.ndarray
    open: np.ndarray
    k: int
    same: bool

    @classmethod
    def of(cls, anchor, low, top, k: int, same: bool) -> Asked:
        n = len(anchor)
        return cls(np.arange(n), anchor, top, top.copy(), low.copy(), np.zeros(n, np.uint64), np.full(n, _LAST_ID), np.full(n, k), np.ones(n, bool), k, same)

    def shifts(self) -> tuple[np.ndarray, np.ndarray]:
        """How far scores, and identifiers, are shifted to leave one digit of their interval."""
        bits = lambda x: np.array([max(0, int(v).bit_length() - DIGIT) for v in x], dtype=np.uint64)
        return bits(self.high - self.low), bits(self.last - self.first)

    def take(self, at: np.ndarray) -> Asked:
        return replace(self, **{x: getattr(self, x)[at] for x in ("mark", "anchor", "top", "high", "low", "first", "last", "need", "open")})


@dataclass
class Block:
    """Anchors: integer vectors, labels, identifiers."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    scale: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(anchor, row) inner products, exact: by floating-point products while these stay integers, else by integer ones."""
        if float(np.abs(self.vectors).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**53:
            return (self.vectors.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return self.vectors @ x.T


def _id_keys(ids: pa.Array) -> np.ndarray:
    """Identifiers as unsigned integers of the same order; null is last."""
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    keys[ids.is_null().to_numpy(zero_copy_only=False)] = _LAST_ID
    return keys


def _met(batches, block: Block, asked: Asked, lowest: np.ndarray, highest: np.ndarray):
    """For every piece of the rows: windows and rows between ``lowest`` and ``highest`` score that fit by label: window, score, identifier, its key."""
    n, dims = block.vectors.shape
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, asked.anchor, lowest)
    np.maximum.at(high, asked.anchor, highest)
    begin, count = np.searchsorted(asked.anchor, np.arange(n)), np.bincount(asked.anchor, minlength=n)
    for b in slices(batches, max(dims, n * SLICE // SCORES)):
        x = integers(b.column("_vector"), block.scale, dims, room(dims))
        s = block.scores(x)
        labels, keys = b.column("_label").to_numpy(zero_copy_only=False), _id_keys(b.column("_id"))
        fits = (s >= low[:, None]) & (s <= high[:, None])
        fits &= (block.labels[:, None] == labels) if asked.same else (block.labels[:, None] != labels)
        a, r = np.nonzero(fits)
        times = count[a]
        a, r = np.repeat(a, times), np.repeat(r, times)
        w = begin[a] + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        score = s[a, r]
        inside = (score >= lowest[w]) & (score <= highest[w])
        w, r, score = w[inside], r[inside], score[inside]
        yield w, score, b.column("_id").take(pa.array(r)), keys[r]


def _counts(rows: DataFrame, block: Block, asked: Asked) -> dict[int, tuple[int, int, int]]:
    """For each window with rows in its interval: the bucket of the last row asked for, the bucket's rows, and rows up to its end."""
    held = rows.sparkSession.sparkContext.broadcast((block, asked))

    def count(batches):
        block, asked = held.value
        by_score, by_id = asked.shifts()
        single, found = asked.high == asked.low, np.zeros(len(asked.anchor) << DIGIT, dtype=np.int64)
        for w, score, _, key in _met(batches, block, asked, asked.low, asked.high):
            inside = ~single[w] | ((key >= asked.first[w]) & (key <= asked.last[w]))
            w, score, key = w[inside], score[inside], key[inside]
            digit = np.where(single[w], (key - asked.first[w]) >> by_id[w], (asked.high[w] - score).astype(np.uint64) >> by_score[w])
            found += np.bincount((w << DIGIT) + digit.astype(np.int64), minlength=len(found))
        found = found.reshape(-1, 1 << DIGIT)
        w, digit = np.nonzero((found > 0) & (np.cumsum(found, axis=1) - found < asked.need[:, None]))
        columns = {"w": pa.array(w, pa.int32()), "need": pa.array(asked.need[w], pa.int32()), "digit": pa.array(digit, pa.int32()), "n": pa.array(found[w, digit], pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)

    total = rows.mapInArrow(count, "w int, need int, digit int, n bigint").groupBy("w", "need", "digit").agg(F.sum("n").alias("n"))
    upto = total.withColumn("upto", F.sum("n").over(Window.partitionBy("w").orderBy("digit")))  # at most 2**DIGIT rows a window
    last = upto.filter("upto - n < need").groupBy("w").agg(F.max(F.struct("digit", "n", "upto")).alias("x")).select("w", "x.*")
    out = {r["w"]: (r["digit"], r["n"], r["upto"]) for r in last.collect()}
    held.unpersist()
    return out


def _located(rows: DataFrame, block: Block, asked: Asked) -> Asked:
    """The windows that have rows, with intervals refined until at most GATHER rows lie above their ends, or all there are."""
    has = np.ones(len(asked.anchor), bool)
    while asked.open.any():
        at = np.nonzero(asked.open)[0]
        found = _counts(rows, block, asked.take(at))
        by_score, by_id = asked.shifts()
        for i, w in enumerate(at):
            if i not in found:
                has[w] = asked.open[w] = False
                continue
            digit, n, upto = found[i]
            if upto < asked.need[w]:  # the window holds no more
                asked.open[w] = False
                continue
            asked.need[w] -= upto - n
            single = asked.high[w] == asked.low[w]
            if single:
                begin, width = int(asked.first[w]) + (digit << int(by_id[w])), 1 << int(by_id[w])
                asked.first[w], asked.last[w] = begin, min(int(asked.last[w]), begin + width - 1)
            else:
                top, width = int(asked.high[w]) - (digit << int(by_score[w])), 1 << int(by_score[w])
                asked.high[w], asked.low[w] = top, max(int(asked.low[w]), top - width + 1)
            few = asked.k - asked.need[w] + n <= GATHER
            asked.open[w] = not few and not (single and asked.first[w] == asked.last[w])
    return asked.take(has)


def _gathered(rows: DataFrame, block: Block, asked: Asked, told: dict[str, pa.Array]) -> DataFrame:
    """The first k rows of each window: w, what is ``told`` of the window by its mark, rank, id, score."""
    held = rows.sparkSession.sparkContext.broadcast((block, asked, told))

    def best(batches):
        block, asked, told = held.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0, np.uint64))
        for w, score, ids, key in _met(batches, block, asked, asked.low, asked.top):
            inside = (score > asked.low[w]) | (key <= asked.last[w])
            more = (w[inside], score[inside], ids.filter(pa.array(inside)), key[inside])
            w, score, key = (np.concatenate([kept[i], more[i]]) for i in (0, 1, 3))
            ids = pa.concat_arrays([kept[2], more[2]])
            order = np.lexsort((key, -score, w))
            begin = np.searchsorted(w[order], w[order])
            order = order[np.arange(len(order)) - begin < asked.k]
            kept = (w[order], score[order], ids.take(pa.array(order)), key[order])
        w, score, ids, _ = kept
        columns = {"w": pa.array(w, pa.int32())} | {name: v.take(pa.array(asked.mark[w])) for name, v in told.items()} | {"id": ids, "score": pa.array(score, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)

    found = rows.mapInArrow(best, ", ".join(["w int", *(f"{name} bigint" for name in told), "id bigint", "score bigint"]))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), F.asc_nulls_last("id")))  # GATHER rows a window, or k a task where rows repeat
    return found.withColumn("rank", rank).filter(F.col("rank") <= asked.k)


def _positives(rows: DataFrame, block: Block, k: int, most: int) -> list[tuple[int, int | None, int]]:
    """(anchor, id, score) of each anchor's first ``k`` rows of its label but for itself; no component is beyond ``most``."""
    reach = np.abs(block.vectors).sum(axis=1) * most
    asked = _located(rows, block, Asked.of(np.arange(len(reach)), -reach, reach, k + 1, True))
    found: dict[int, list] = {}
    for r in _gathered(rows, block, asked, {"a": pa.array(np.arange(len(reach)))}).collect():  # k + 1 an anchor
        found.setdefault(r["a"], []).append((r["rank"], r["id"], r["score"]))
    own, out = np.einsum("ad,ad->a", block.vectors, block.vectors), []
    for a in sorted(found):
        some = [(i, s) for _, i, s in sorted(found[a], key=lambda x: x[0])]
        if (itself := (int(block.ids[a]), int(own[a]))) in some:  # of rows with this identifier and score, one is the anchor
            some.remove(itself)
        out += [(a, i, s) for i, s in some[:k]]
    return out


def mine(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``low`` and ``high`` are percents of the positive's score."""
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("bigint").alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_vector"))
    rows = whole(rows.filter(F.col("_label").isNotNull()), "_vector")
    is_anchor = F.col("_id") % every == 0
    n, dims, far = rows.agg(F.count_if(is_anchor), F.max(F.size("_vector")), F.max(F.greatest(F.array_max("_vector"), -F.array_min("_vector")))).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], schema)
    dims = max(dims, 1)
    most = int(min(room(dims), scale * (far or 0) + 1))
    blocks = -(-n // max(1, min(BLOCK, BLOCK_COMPONENTS // dims)))
    path = f"{shared_dir(spark)}/shelfmark/hard-negatives-{uuid.uuid4().hex}"
    dealt = rows.filter(is_anchor).repartition(blocks).withColumn("_block", F.spark_partition_id())
    dealt.write.partitionBy("_block").parquet(f"{path}/anchors")
    anchors = spark.read.schema(dealt.schema).parquet(f"{path}/anchors")
    for i in range(blocks):
        some = anchors.filter(F.col("_block") == i).collect()  # one block: bounded
        if not some:
            continue
        vectors = integers(pa.array([r["_vector"] for r in some], pa.list_(pa.float64())), scale, dims, room(dims))
        block = Block(vectors, pa.array([r["_label"] for r in some]).to_numpy(zero_copy_only=False), np.array([r["_id"] for r in some], dtype=np.int64), scale)
        windows = [(a, p, s, -(-low * s // 100), high * s // 100) for a, p, s in _positives(rows, block, positives, most)]
        windows = [w for w in windows if w[3] <= w[4]]
        anchor, positive, score, bottom, top = zip(*windows, strict=True) if windows else [()] * 5
        ints = lambda x: np.array(x, dtype=np.int64)
        asked = _located(rows, block, Asked.of(ints(anchor), ints(bottom), ints(top), negatives, False))
        told = {"anchor_id": pa.array(block.ids[ints(anchor)]), "positive_id": pa.array(positive, pa.int64()), "positive_score": pa.array(score, pa.int64())}
        found = _gathered(rows, block, asked, told).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        found.select(*[x.split()[0] for x in schema.split(", ")]).write.parquet(f"{path}/found/part={i}")
    return spark.read.schema(schema).parquet(f"{path}/found/*")


MINE_SQL = f"""
with kept as (
  select row_number() over (order by vec_id) as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor({SCALE} * cast(x as double)) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), met as (
  select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from kept a, kept b where a.vec_id % {EVERY} = 0 and a.r <> b.r
), positive as (
  select * from met where same qualify row_number() over (partition by a order by score desc, vec_id) <= {POSITIVES}
)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.a, p.b order by m.score desc, m.vec_id) as integer) as rank, m.vec_id as negative_id, p.score as positive_score, m.score as negative_score
from positive p join met m on p.a = m.a and not m.same and {LOW} * p.score <= 100 * m.score and 100 * m.score <= {HIGH} * p.score
qualify rank <= {NEGATIVES}"""
