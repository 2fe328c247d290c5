"""Alignment of two tokenizers' tokens: union-find over the bipartite graph of overlapping tokens.

A text's tokens by A and by B each cover the same bytes.  The nodes of the graph are token occurrences, and an edge, or
link, joins an A and a B token that share a byte; there is one for each stretch between two neighbouring token ends, so
there are fewer than tokens.  Union-find takes the smaller root of each edge's two ends until no edge joins two roots;
the components are exactly the minimal groups, the runs between bytes where tokens of A and B both end.  The members of
each component keep their links, which are counted over the corpus by pair of ids.

Texts are encoded once.  A row's record holds its numbers, the digest of its groups and its distinct linked pairs of ids
with their counts, and is written to the shared folder.  Counts of pairs are summed up in chunks of records before they
are shuffled.  The pairs of the highest counts, ``HEAD`` at most, are broadcast and hold most links; links of all others
go to a join by pair, so no frequent pair is shuffled.  Each B id's highest count is a table as long as its vocabulary.

Defined cases: null and empty texts, and those whose tokens' bytes, joined, aren't blank + text, have no tokens (zeros,
and '' as digest); special tokens' strings are plain text; repeated rows count once each; an empty table gives an empty
one; very long texts are encoded whole; other columns, whatever their names, are kept by ``aligned`` and not read by
``pair_scores``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.arrow import extended, pieces, with_fields
from lexweave.llm.common import Held, cut, table
from lexweave.llm.tokenizers_read import ByteBpe, Pieces, contents, tokenizer

FOLDER, A, B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are broadcast at most, 17 bytes each.
HEAD = 1 << 19
#: Bytes of text that are aligned together, and pairs that are summed up together.
TEXT_BYTES, PAIRS = 2 << 20, 1 << 21
_INTS = T.ArrayType(T.IntegerType(), False)
_RECORD = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType(), False)] + [T.StructField(n, _INTS, False) for n in ("pair_a", "pair_b", "pair_n")]
)


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each node's root, the smallest node of its component, for edges u - v among nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


@dataclass
class Alignment:
    """Tokens, links and groups of several texts; sizes and starts are by text, groups are numbered across texts."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray

    @property
    def a_starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.a_sizes)))

    @property
    def b_starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.b_sizes)))


class Aligner:
    def __init__(self, a: ByteBpe | Pieces, b: ByteBpe | Pieces):
        self.a, self.b = a, b
        self._a_length, self._b_length = (np.array([len(p) for p in x.pieces]) for x in (a, b))
        # Each id as decimal digits and the mark that follows it: an A id's "," or "|", a B id's ",", ";" or none.
        texts = [f"{i}{m}".encode() for n, marks in ((len(a.pieces), ",|"), (len(b.pieces), (",", ";", ""))) for m in marks for i in range(n)]
        self._width = max(map(len, texts))
        self._digits = np.frombuffer(b"".join(x.ljust(self._width, b"\0") for x in texts), np.uint8).reshape(-1, self._width)

    def align(self, texts: list[str | None]) -> Alignment:
        own = [t or "" for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in own]
        a, a_sizes, right = self.a.encode(own, raw)
        b, b_sizes, also = self.b.encode(own, raw)
        right &= also & np.array([bool(t) for t in own], bool)
        a, b = a[np.repeat(right, a_sizes)], b[np.repeat(right, b_sizes)]
        a_sizes, b_sizes = np.where(right, a_sizes, 0), np.where(right, b_sizes, 0)
        # Both cover the same bytes, so ends are counted on across texts.
        a_ends, b_ends = np.cumsum(self._a_length[a]), np.cumsum(self._b_length[b])
        marks = np.zeros((int(a_ends[-1]) if len(a) else 0) + 1, np.int8)
        marks[a_ends] = 1
        marks[b_ends] |= 2
        marks = marks[np.flatnonzero(marks)]
        before = lambda bit: np.cumsum((marks & bit) > 0) - ((marks & bit) > 0)
        link_a, link_b = before(1), before(2)
        root = union_find(len(a) + len(b), link_a, len(a) + link_b)
        # A component's smallest node is its first A token, and components follow one another.
        first = root[: len(a)] == np.arange(len(a))
        number = np.cumsum(first) - 1
        return Alignment(a, b, a_sizes, b_sizes, link_a, link_b, number[root[: len(a)]], number[root[len(a) :]])

    def digests(self, found: Alignment) -> list[str]:
        """SHA-256 of each text's groups written as ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
        n_a, n_b = len(self.a.pieces), len(self.b.pieces)
        a_last = np.append(found.a_group[1:] != found.a_group[:-1], True)[: len(found.a)]
        b_last = np.append(found.b_group[1:] != found.b_group[:-1], True)[: len(found.b)]
        of_text = np.zeros(len(found.b), bool)
        of_text[found.b_starts[1:][found.b_sizes > 0] - 1] = True
        signs = np.empty(len(found.a) + len(found.b), np.int64)
        # Members of a group stand together, A before B.
        signs[np.arange(len(found.a)) + np.searchsorted(found.b_group, found.a_group, "left")] = found.a + n_a * a_last
        signs[np.arange(len(found.b)) + np.searchsorted(found.a_group, found.b_group, "right")] = found.b + 2 * n_a + n_b * (b_last.astype(np.int64) + of_text)
        digits = self._digits[signs]
        kept = digits != 0
        ends = np.concatenate(([0], np.cumsum(kept.sum(1))))
        written, edges = digits[kept].tobytes(), ends[found.a_starts + found.b_starts].tolist()
        return [hashlib.sha256(written[s:e]).hexdigest() if e > s else "" for s, e in zip(edges[:-1], edges[1:])]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _aligner(names: tuple[str, str], files: tuple[bytes, bytes]) -> Aligner:
    return Aligner(*[tokenizer(n, f) for n, f in zip(names, files)])


def aligned(docs: DataFrame, text: str = "text", folder: str = FOLDER, a: str = A, b: str = B) -> DataFrame:
    """``docs`` with the ids a_ids and b_ids of their tokens, and the numbers a_groups and b_groups of these tokens' groups."""
    held, names = Held(docs, None, text), (a, b)
    files = docs.sparkSession.sparkContext.broadcast((contents(folder, a), contents(folder, b)))
    schema = with_fields(held.rows.schema, [T.StructField(n, _INTS, False) for n in ("a_ids", "b_ids", "a_groups", "b_groups")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(names, files.value)
        for batch in pieces(batches, "t", TEXT_BYTES):
            x = own.align(batch.column("t").to_pylist())
            groups = []
            for of, starts, sizes in ((x.a_group, x.a_starts, x.a_sizes), (x.b_group, x.b_starts, x.b_sizes)):
                groups.append(of - np.repeat(of[np.minimum(starts[:-1], len(of) - 1)] if len(of) else starts[:-1], sizes))
            values = {"a_ids": _lists(x.a, x.a_sizes), "b_ids": _lists(x.b, x.b_sizes), "a_groups": _lists(groups[0], x.a_sizes), "b_groups": _lists(groups[1], x.b_sizes)}
            yield extended(batch, schema, values)

    return held.back(held.rows.mapInArrow(run, schema), ["a_ids", "b_ids", "a_groups", "b_groups"])


def alignment_records(docs: DataFrame, key: str, text: str, folder: str = FOLDER, a: str = A, b: str = B) -> DataFrame:
    """(k, n_a, n_b, n_groups, n_links, groups_sha256, pair_a, pair_b, pair_n) of each row: its numbers, the digest of its
    groups, and its distinct linked pairs of ids with the number of its links that hold them."""
    rows, names = Held(docs, key, text).rows.select("k", "t"), (a, b)
    files = docs.sparkSession.sparkContext.broadcast((contents(folder, a), contents(folder, b)))
    schema = T.StructType([rows.schema["k"], *_RECORD.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(names, files.value)
        width = len(own.b.pieces)
        for batch in pieces(batches, "t", TEXT_BYTES):
            x = own.align(batch.column("t").to_pylist())
            n = batch.num_rows
            of_a = np.repeat(np.arange(n), x.a_sizes)
            codes, times = np.unique((of_a[x.link_a] * len(own.a.pieces) + x.a[x.link_a]) * width + x.b[x.link_b], return_counts=True)
            whose, pair = np.divmod(codes, len(own.a.pieces) * width)
            sizes = np.bincount(whose, minlength=n)
            firsts = np.append(True, x.a_group[1:] != x.a_group[:-1])[: len(x.a)]
            numbers = {"n_a": x.a_sizes, "n_b": x.b_sizes, "n_groups": np.bincount(of_a[firsts], minlength=n), "n_links": np.bincount(of_a[x.link_a], minlength=n)}
            values = {c: pa.array(v.astype(np.int64)) for c, v in numbers.items()} | {"groups_sha256": own.digests(x)}
            yield extended(batch, schema, values | {"pair_a": _lists(pair // width, sizes), "pair_b": _lists(pair % width, sizes), "pair_n": _lists(times, sizes)})

    return rows.mapInArrow(run, schema)


def pair_counts(records: DataFrame) -> DataFrame:
    """(a, b, n): how many links of all records hold a pair of ids linked."""
    schema = "a int, b int, n bigint"

    def summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, at, np.concatenate(times))
        return found, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found, n = summed(codes, times)
            return pa.RecordBatch.from_arrays([pa.array((found >> 32).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        codes, times, size = [], [], 0
        for batch in batches:
            a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair_a", "pair_b", "pair_n"))
            codes.append((a << 32) | b)
            times.append(n)
            size += len(a)
            if size >= PAIRS:
                yield out()
                codes, times, size = [], [], 0
        if size:
            yield out()

    return records.select("pair_a", "pair_b", "pair_n").mapInArrow(run, schema).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> int:
    """The least count such that ``most`` pairs at most have it or a higher one."""
    step = F.floor(F.log2("n") * 8)
    found = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("s")).collect()
    least, held = 1 << 62, 0
    for r in found:
        held += r["pairs"]
        if held > most:
            break
        least = r["n"]
    return least


def pair_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, a: str = A, b: str = B, head: int = HEAD) -> DataFrame:
    """(k, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row: its alignment, how many of its links
    have the highest count of their B id, and the sum of its links' counts.

    Intermediate tables lie in the shared folder: records, counts of pairs, and records with what the head gave.
    """
    spark = docs.sparkSession
    records = cut(alignment_records(docs, key, text, folder, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(records))
    # One row for each B id, so no more than its vocabulary has.
    highest = counts.groupBy("b").agg(F.max("n").alias("high"))
    rated = counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("high")).alias("best"))
    least = _head(counts, head)
    top = rated.where(F.col("n") >= least).toArrow()
    code = (top.column("a").to_numpy().astype(np.int64) << 32) | top.column("b").to_numpy()
    order = np.argsort(code)
    known = spark.sparkContext.broadcast((code[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order].astype(np.int64)))
    numbers = ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    more = [T.StructField("n_best", T.LongType(), False), T.StructField("count_sum", T.LongType(), False), *[T.StructField(n, _INTS, False) for n in ("rest_a", "rest_b", "rest_n")]]
    schema = T.StructType([records.schema[c] for c in ["row", *numbers]] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = known.value
        for batch in batches:
            sizes = np.diff(batch.column("pair_a").offsets.to_numpy())
            pair_a, pair_b, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair_a", "pair_b", "pair_n"))
            asked = (pair_a << 32) | pair_b
            at = np.minimum(np.searchsorted(codes, asked), max(0, len(codes) - 1))
            met = codes[at] == asked if len(codes) else np.zeros(len(asked), bool)
            whose = np.repeat(np.arange(batch.num_rows), sizes)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], whose[met], times[met] * best[at[met]])
            np.add.at(sums[1], whose[met], times[met] * n[at[met]])
            left = np.bincount(whose[~met], minlength=batch.num_rows)
            rest = {c: _lists(v[~met], left) for c, v in (("rest_a", pair_a), ("rest_b", pair_b), ("rest_n", times))}
            small = pa.RecordBatch.from_arrays([batch.column(c) for c in ["row", *numbers]], names=["row", *numbers])
            yield extended(small, schema, {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])} | rest)

    met = cut(records.mapInArrow(run, schema))
    known.destroy()
    links = met.where(F.size("rest_a") > 0).select("row", F.explode(F.arrays_zip("rest_a", "rest_b", "rest_n")).alias("p")).select("row", F.col("p.rest_a").alias("a"), F.col("p.rest_b").alias("b"), F.col("p.rest_n").alias("times"))
    found = links.join(rated.where(F.col("n") < least), ["a", "b"]).groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = met.select("row", *numbers, "n_best", "count_sum").join(found, "row", "left")
    return both.select(*numbers, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def op12_union_find_alignment(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    return pair_scores(table(spark, sf_dir, "documents"), folder=folder).withColumnRenamed("k", "doc_id")
