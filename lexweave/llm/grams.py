"""Hashed word n-grams of many documents, dealt out as packed blobs instead of a row each.

A corpus has about as many n-grams as words, and as rows of their own they would take several times the corpus's size
in a shuffle.  Here a worker gathers the hashes of many documents (a chunk), deals them into buckets by hash, and sends
each bucket one row: hashes, the documents they are from, and how many are from each.  The same way the answers go
back to the documents' home buckets.  All rows of such an exchange have the schema ``MESSAGE``.

The number of buckets follows from the input's size, that of partitions is Spark's; a partition's rows come sorted by
bucket (Spark sorts, and spills, in the JVM), so a worker holds one bucket's rows at a time, whatever a partition holds.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: dest: bucket to go to; kind: what the row is; the rest depends on the kind.
MESSAGE = "dest int, kind int, doc bigint, key bigint, n bigint, m bigint, a binary, b binary, c binary, d binary"
_ARROW = pa.schema([(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in MESSAGE.split(", ")])
#: Hashes of a chunk: a worker keeps some 100 bytes for each.
CHUNK = 500_000
_REMEMBERED = 200_000
#: Bytes of files, compressed, that a bucket stands for, and buckets at most (a bucket and 44 bits of a hash make 64).
BUCKET_BYTES, _MOST_BUCKETS = 16 << 20, (1 << 20) - 1
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tidied(step: Callable) -> Callable:
    """A step of record batches that gives freed memory back to the system in the end, as workers live on."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


class WordHashes(dict):
    """64-bit hash of a word's bytes; remembers those of many words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _REMEMBERED:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive words, from the words' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _MULTIPLIER
        out += hashes[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def row_key(doc_id: int | None, text: bytes) -> int:
    """Signed 64-bit key of a row: equal for equal rows only."""
    return xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh3_64_intdigest(repr(doc_id).encode())) - (1 << 63)


def home(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.astype(np.uint64) >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def partitions_of(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(df: DataFrame) -> int:
    """Buckets of an exchange: one for each ``BUCKET_BYTES`` of the files that ``df`` reads, and one a partition at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # Spark takes 8 EiB for what it knows nothing of
    return min(_MOST_BUCKETS, max(partitions_of(df), -(-known // BUCKET_BYTES)))


def exchanged(df: DataFrame, buckets: int, kinds: bool = False) -> DataFrame:
    """Rows at their bucket's partition, bucket by bucket; kinds: and by kind in a bucket."""
    partitions = partitions_of(df)
    out = df.repartitionById(partitions, F.pmod("dest", F.lit(partitions)).cast("int"))
    if kinds:
        return out.sortWithinPartitions("dest", "kind")
    # With no more buckets than partitions each partition is one bucket.
    return out.sortWithinPartitions("dest") if buckets > partitions else out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """The rows of a partition, bucket by bucket."""
    rows = (m for batch in batches for m in rows_of(batch))
    return itertools.groupby(rows, key=lambda m: m["dest"])


class Outbox:
    """Gathers messages into record batches."""

    def __init__(self, most: int = 4 << 20):
        self.most, self.bytes = most, 0
        self.rows: list[dict] = []

    def put(self, **row) -> None:
        self.rows.append(row)
        self.bytes += 100 + sum(len(row.get(x) or b"") for x in "abcd")

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.bytes >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], type=f.type) for f in _ARROW], schema=_ARROW)
            self.rows, self.bytes = [], 0


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one at a time."""
    columns = [batch.column(batch.schema.get_field_index(x)) for x in _ARROW.names]
    for i in range(batch.num_rows):
        yield {x: c[i].as_py() for x, c in zip(_ARROW.names, columns)}


def dealt(dest: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Deals entries out by destination: (destination, entries in order of owner, their owners, how many each).

    owner: number of each entry's document, ascending.
    """
    order = np.argsort(dest.astype(np.uint16) if len(dest) and dest.max() < 65536 else dest, kind="stable")
    to = dest[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else []
    for a, b in zip(edges[:-1], edges[1:]):
        part = order[a:b]
        who = owner[part]
        first = np.concatenate(([0], np.flatnonzero(np.diff(who)) + 1))
        yield int(to[a]), part, who[first], np.diff(np.concatenate((first, [len(who)]))).astype(np.uint32)


def groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))
    return starts, np.concatenate((starts[1:], [len(sorted_values)]))
