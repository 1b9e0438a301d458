"""Arrow batches inside tasks: columns pass as they are, so that identifiers keep all their bits beside nulls."""

from __future__ import annotations

import pyarrow as pa


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    """A column's values as Python strings; null is None."""
    return batch.column(column).to_numpy(zero_copy_only=False).tolist()


def beside(batch: pa.RecordBatch, passed: list[str], **new) -> pa.RecordBatch:
    """Columns of ``batch`` as they are, then ``new`` ones, each of values and an Arrow type."""
    made = [pa.array(values, kind) for values, kind in new.values()]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *made], names=[*passed, *new])


def replaced(batch: pa.RecordBatch, column: str, values: list) -> pa.RecordBatch:
    """``batch`` with other values in one column of it."""
    at = batch.schema.get_field_index(column)
    return batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
