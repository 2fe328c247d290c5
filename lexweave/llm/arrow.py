"""Arrow helpers for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column's values."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of one column, so that few values are Python objects at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(batch.num_rows, int(most * batch.num_rows / max(1, batch.column(column).nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """``schema`` with further fields, which replace those of the same name."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + fields)


def extended(batch: pa.RecordBatch, schema: T.StructType, values: dict[str, list | pa.Array]) -> pa.RecordBatch:
    """``batch`` with new columns, in the order of ``schema``."""
    target = to_arrow_schema(schema)
    arrays = []
    for f in target:
        v = values[f.name] if f.name in values else batch.column(f.name)
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)
