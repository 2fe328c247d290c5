"""What the operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1024


def whole(vector: Column) -> Column:
    """A vector that isn't null and holds neither null nor non-finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def scaled(vector: Column, offset: int = 0) -> Column:
    """Each component c as the integer floor(1024 * c) + offset."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(offset).cast("bigint"))


def by_length(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of a batch's vectors, none of which may be null."""
    column = batch.column(vector)
    offsets = column.offsets.to_numpy()
    lengths, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]
