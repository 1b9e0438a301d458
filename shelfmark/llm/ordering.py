"""Rows in a global order, dealt into ranges that also see the rows next to their ends.

A window without partitions would put the table in one task. Here the key is cut into ranges at bounds from a bounded
sample (``SAMPLE`` keys a range); each range is one partition, sorted, and gets a copy of its neighbours' last and
first row, marked as a halo. The bounds affect only how even the ranges are. The driver holds a few keys a range.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

SAMPLE, RANGE_BYTES = 16, 16 << 20


def in_order(df: DataFrame, keys: list[str], circular: bool = False, ties: list[str] = (), only: DataFrame | None = None, alike: str | None = None, size: str | None = None) -> DataFrame:
    """``df`` with ``_range`` and ``_halo``, one range a partition, sorted by ``keys`` then ``ties``.

    A halo row is a copy of the nearest row of the next range on either side; with ``circular`` the last row of all is
    also a halo before the first. Keys are compared as Spark compares them and must not be null. Rows of equal keys
    stay in one range. ``only`` may give the same keys at less cost than ``df``. With ``alike``, a column of both and the
    first of the ties, the halo rows are the nearest that differ in it from the row at the range's end, however far off.
    With ``size``, a column of ``only``, there are as many more ranges as keep one at about ``RANGE_BYTES``.
    """
    n = partitions(df.sparkSession)
    only = df if only is None else only
    total, held = only.agg(F.count("*"), F.sum(size) if size else F.lit(0)).first()
    n = max(n, -(-int(held or 0) // RANGE_BYTES))
    only = only.select(*keys, *([alike] if alike else []))
    share = min(1.0, SAMPLE * n / max(total, 1))
    sample = only.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(4 * SAMPLE * n).collect()
    found = sorted({tuple(r) for r in sample})
    bounds = [found[len(found) * i // n] for i in range(1, n)] if found else []
    bounds = sorted(set(bounds))

    @F.pandas_udf("int")
    def range_of(*columns: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) for k in zip(*columns, strict=True)], dtype="int32")

    key = F.struct(*keys)
    ranged = only.withColumn("_range", range_of(*keys))
    ends = ranged.groupBy("_range").agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()
    ends = sorted((r["_range"], tuple(r["a"]), tuple(r["b"])) for r in ends)
    to: dict[tuple, list[int]] = {}
    if alike:
        for k, x in _unlike(ranged, keys, alike):
            to.setdefault(k, []).append(x)
    else:
        for here, after in zip(ends, ends[1:], strict=False):
            to.setdefault(here[2], []).append(after[0])
            to.setdefault(after[1], []).append(here[0])
    first = ends[0][0] if circular and ends else -1
    last = ends[-1][2] if ends else None

    @F.pandas_udf("array<struct<at:int,halo:int>>")
    def places(*columns: pd.Series) -> pd.Series:
        out = []
        for k in zip(*columns, strict=True):
            at = [{"at": bisect_right(bounds, k), "halo": 0}] + [{"at": x, "halo": 1} for x in to.get(k, ())]
            out.append([*at, {"at": first, "halo": 2}] if first >= 0 and k == last else at)
        return pd.Series(out)

    dealt = df.withColumn("_place", F.explode(places(*keys))).select("*", F.col("_place.at").alias("_range"), F.col("_place.halo").alias("_halo")).drop("_place")
    return dealt.repartitionById(max(n, 1), F.col("_range")).sortWithinPartitions(F.col("_halo") != 2, *keys, *ties)


def _unlike(ranged: DataFrame, keys: list[str], alike: str) -> set[tuple[tuple, int]]:
    """Keys and the ranges they are halos of: the nearest on either side that differ in ``alike`` from the range's end."""
    full = F.struct(*keys, alike)
    of = ranged.groupBy("_range", alike).agg(F.min(full).alias("a"), F.max(full).alias("b"))
    up, down = Window.partitionBy("_range").orderBy("a"), Window.partitionBy("_range").orderBy(F.desc("b"))
    of = of.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).filter("up <= 2 OR down <= 2")
    first: dict[int, list[tuple]] = {}
    last: dict[int, list[tuple]] = {}
    for r in sorted(of.collect(), key=lambda r: (r["up"], r["down"])):
        if r["up"] <= 2:
            first.setdefault(r["_range"], []).append(tuple(r["a"]))
        if r["down"] <= 2:
            last.setdefault(r["_range"], []).append((r["down"], tuple(r["b"])))
    order, out = sorted(first), set()
    for side, ends, others in ((order, {x: v[0][-1] for x, v in first.items()}, {x: [k for _, k in sorted(v)] for x, v in last.items()}), (order[::-1], {x: min(v)[1][-1] for x, v in last.items()}, first)):
        before: list[tuple] = []  # nearest first: the last row, and the last row that differs from it
        for x in side:
            if k := next((k for k in before if k[-1] != ends[x]), None):
                out.add((k[:-1], x))
            before = others[x] if len(others[x]) > 1 else others[x] + [k for k in before if k[-1] != others[x][0][-1]][:1]
    return out
