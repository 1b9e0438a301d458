"""Vectors of finite components, turned into integers inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components, at most, that a task holds as integers at a time.
SLICE = 1 << 20


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose ``vector`` is neither null nor holds a null, an infinity or NaN; components become double.

    ``array_contains`` is null for a list that holds nulls and lacks the value, so such lists fail the test as well.
    """
    v = F.col(vector).cast("array<double>")
    odd = F.array_contains(v, float("nan")) | F.array_contains(v, float("inf")) | F.array_contains(v, float("-inf"))
    return rows.withColumn(vector, v).filter(v.isNotNull() & ~odd)


def room(dims: int) -> int:
    """The largest component for which sums of ``dims`` products, or of squared differences, stay within int64."""
    return 1 << ((62 - max(1, dims).bit_length()) // 2 - 1)


def integers(vectors: pa.Array, scale: int, dims: int, most: int) -> np.ndarray:
    """floor(scale * x) of lists, as rows of ``dims`` int64; missing components are 0, those beyond ``most`` are taken as it."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    whole_ = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(lengths) * dims and (lengths == dims).all():
        return whole_.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = whole_
    return out


def slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """The batches again, none with more than ``SLICE`` components."""
    rows = max(1, SLICE // max(1, dims))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
