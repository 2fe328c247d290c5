"""Incremental ingest: appends only keys that a table doesn't have yet, batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexweave.sources.keyed import KeyedTable


def append_missing(path: str, keys: Sequence[str], run: str, order: str | None = None, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: adds a batch's new keys to a keyed table, so that repeated input changes nothing.

    A batch that is tried again, as one that was half written is, writes its folders anew and is held against all others.
    """
    table = KeyedTable(path, keys, buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.append(batch, run, number, order)

    return write


def ingest(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Starts the ingest of what is there now; a run is what has one checkpoint folder."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(append_missing(path, keys, run, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
