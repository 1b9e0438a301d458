"""Vector code compression: integer codebooks for each part of the vectors, learnt by rounds of assigning and averaging.

The codebooks, parts x 256 integer entries, are broadcast. In every round each task reads its rows as Arrow batches,
finds the distances of all parts to all entries from norms and one exact int64 matrix product, takes the first nearest
entry and adds the parts up by entry. What a task sends is one row for each part position and entry, however many rows
it read; a grouped shuffle adds these up. Nothing that grows with the table reaches the driver or is broadcast. The
table is read once a round, so that no copy of it is written.

Defined results: rows whose vector is null or holds a null or non-finite component are absent; an empty table gives an
empty one; with fewer rows than entries the codebooks have as many entries as there are rows; equal vec_ids are ordered
by their vectors, a null vec_id is last and stays null; rows that repeat each count; null labels are one label. Vectors
shorter than the longest, or not divisible by the parts, are filled up with zeros. A scaled component beyond
``vectors.room`` (2**27 for parts of 16) is taken as that bound, so that distances fit a long. Columns other than the
three asked for are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .vectors import integers, room, slices, whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A label with more than one in so many rows is hot. There are fewer hot labels than this, so they can be broadcast.
HOT = 1000


class Codebooks:
    """entries[part, entry] is the integer vector of an entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = np.einsum("ped,ped->pe", entries, entries)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of (part, component): the first nearest entry of each part, and the squared distance to it."""
        at = np.empty(rows.shape[:2], dtype=np.int64)
        far = np.empty(rows.shape[:2], dtype=np.int64)
        for p in range(rows.shape[1]):
            x = rows[:, p]
            d = self.norms[p] - 2 * (x @ self.entries[p].T)
            at[:, p] = d.argmin(axis=1)
            far[:, p] = d[np.arange(len(d)), at[:, p]] + np.einsum("nd,nd->n", x, x)
        return at, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _parts(batches: Iterator[pa.RecordBatch], parts: int, dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in slices(batches, parts * dims):
        yield b, integers(b.column("_vector"), scale, parts * dims, room(dims)).reshape(b.num_rows, parts, dims)


def averaged(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry becomes the floored mean of its parts."""
    parts, entries, dims = books.entries.shape
    held = rows.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add(batches):
        sums, n = np.zeros((parts, entries, dims), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, x in _parts(batches, parts, dims, scale):
            at, _ = held.value.nearest(x)
            for p in range(parts):
                order = np.argsort(at[:, p], kind="stable")
                entry, first = np.unique(at[order, p], return_index=True)
                sums[p, entry] += np.add.reduceat(x[order, p], first, axis=0)
                n[p] += np.bincount(at[:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(sums[p, e].tolist(), schema.field("sums").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    of = rows.select("_vector").mapInArrow(add, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry")
    total = of.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(dims))).alias("sums"))
    new = books.entries.copy()
    for r in total.collect():  # parts x entries rows at most
        new[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    held.unpersist()
    return Codebooks(new)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``rows`` (_id, _vector of finite doubles), begun with the rows of smallest _id; None without rows."""
    longest = rows.agg(F.max(F.size("_vector"))).first()[0]
    if longest is None:
        return None
    dims = -(-longest // parts)
    first = rows.select("_id", "_vector").orderBy(F.asc_nulls_last("_id"), "_vector").limit(entries).collect()
    begun = integers(pa.array([r["_vector"] for r in first], pa.list_(pa.float64())), scale, parts * dims, room(dims))
    books = Codebooks(np.ascontiguousarray(begun.reshape(len(first), parts, dims).swapaxes(0, 1)))
    for _ in range(rounds):
        books = averaged(rows, books, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error for ``rows`` (_id, _label, _vector)."""
    parts, _, dims = books.entries.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b, x in _parts(batches, parts, dims, scale):
            at, far = held.value.nearest(x)
            codes = [bytes(a).hex() for a in at.astype(np.uint8)]
            made = [b.column("_id"), b.column("_label"), pa.array(codes, pa.string()), pa.array(far.sum(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["vec_id", "label", "code", "error"])

    kinds = [f.dataType.simpleString() for f in rows.select("_id", "_label").schema]
    return rows.select("_id", "_label", "_vector").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error of all rows of the label. Hot labels meet their rows by broadcast, the others by key."""
    totals = keep(codes.groupBy(F.col("label").alias("_of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("_sum"), F.count("*").alias("_n")), "label-errors")
    n = totals.agg(F.sum("_n")).first()[0] or 0
    label_error = F.least("_sum", F.lit((1 << 63) - 1)).cast("bigint").alias("label_error")
    hot = F.broadcast(totals.filter(F.col("_n") * HOT > n))
    mild = totals.filter(F.col("_n") * HOT <= n)
    same = F.col("label").eqNullSafe(F.col("_of"))
    columns = [*codes.columns, label_error]
    return codes.join(hot, same).select(*columns).union(codes.join(hot, same, "left_anti").join(mild, same).select(*columns))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a whole vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = whole(rows.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_vector")), "_vector")
    books = learn(rows, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks(np.zeros((parts, 1, 1), dtype=np.int64))
    codes = keep(encode(rows, books, scale), "codes")
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _compress_sql() -> str:
    near = "select p, r, any_value(vec_id) as vec_id, any_value(label) as label, any_value(x) as x, cast(min((n - 2 * list_inner_product(x, c) + cn) * 256 + e) as bigint) as best from part join {c} using (p) group by p, r"
    steps = []
    for i in range(ROUNDS):
        steps.append(f"a{i} as ({near.format(c=f'c{i}')})")
        steps.append(f"s{i} as (select p, best % 256 as e, i, floor(sum(x[i]) / count(*)) as m from (select p, best, x, unnest(range(1, len(x) + 1)) as i from a{i}) group by p, best % 256, i)")
        steps.append(f"m{i} as (select p, e, list(m order by i) as c from s{i} group by p, e)")
        steps.append(f"c{i + 1} as (select p, e, c, list_inner_product(c, c) as cn from (select p, e, coalesce(m.c, o.c) as c from c{i} o left join m{i} m using (p, e)))")
    last = f"c{ROUNDS}"
    return f"""
with kept as (
  select vec_id, label, [floor({SCALE} * cast(x as double)) for x in embedding] as v, len(embedding) // {PARTS} as d, row_number() over (order by vec_id) as r
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), part as (
  select *, list_inner_product(x, x) as n from (select r, vec_id, label, p, v[p * d + 1 : (p + 1) * d] as x from kept, (select unnest(range({PARTS})) as p))
), c0 as (
  select p, r - 1 as e, x as c, n as cn from part where r <= {ENTRIES}
), {", ".join(steps)}, told as (
  {near.format(c=last)}
), rows as (
  select r, any_value(vec_id) as vec_id, any_value(label) as label, string_agg(lpad(to_hex(best % 256), 2, '0'), '' order by p) as code, cast(sum(best // 256) as bigint) as error from told group by r
)
select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by p, e, i)) from (select p, e, unnest(c) as x, unnest(range(len(c))) as i from {last})) as codebooks_sha256
from rows"""


COMPRESS_SQL = _compress_sql()
