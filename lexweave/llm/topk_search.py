"""Exact top-k search by inner product: branch and bound over ball trees, one for each shard of vectors.

A shard is a run of vectors of one input partition, of bounded bytes, so no vector is shuffled.  Its ball tree halves it
by the median along the line between two far vectors, down to leaves of ``LEAF`` vectors; each node has a centre c and a
radius r, and a query q's inner product with any of its vectors is at most ``q.c + |q| r``.

Queries come in blocks of bounded bytes, which are broadcast one pass at a time; all shards meet every block.  A shard
is searched for the whole block at once: bounds go down the tree level by level and drop the nodes that a query's kth
best can't be beaten in; the leaves left are visited in the order of each query's bounds, some more each round, and the
kth scores found so far cut off the rest.  These scores are shared: from leaf to leaf and from shard to shard within a
task, and between tasks by two waves: the first searches the vectors of one in ``FIRST`` hashes of ids, and its best k of
each query are what all tasks of the second, over all other vectors, start from.

Scores are integers, and exact: sums below 2^53 by doubles, below 2^63 by integers, and an error beyond.  Equal scores go
to the smaller id, also where a bound equals the kth score.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
don't meet; empty vectors score 0; ids that are null are no queries, come last among equal scores and are returned as
null; rows with the query's own id are no candidates of it; repeated candidates each have a rank, repeated queries are
answered once, and rows of one id with different vectors are queries of their own; a query that meets none returns no
row; an empty table gives an empty one; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexweave.llm.common import cut, quoted, table
from lexweave.llm.vectors import by_length, scaled, whole

LEAF = 64
#: Bytes of vectors in a shard, and of query vectors in a pass.
SHARD_BYTES, QUERY_BYTES = 8 << 20, 32 << 20
#: Queries that go down a tree together.
TOGETHER = 2048
#: One in so many hashes of ids is searched first.
FIRST = 16
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
_HITS = T.StructType([T.StructField("q", T.LongType(), False), T.StructField("vec_id", T.LongType(), False), T.StructField("score", T.LongType(), False)])


@dataclass
class Best:
    """The best k of each query so far: scores in falling order, and ids."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls, queries: int, k: int) -> Best:
        return cls(np.full((queries, k), _NONE), np.full((queries, k), _LAST))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes hits of queries ``q`` in, keeping the best k of each by falling score, then smaller id."""
        if not len(q):
            return
        k, asked = self.scores.shape[1], np.unique(q)
        rows = np.concatenate([np.repeat(asked, k), q])
        s, i = np.concatenate([self.scores[asked].ravel(), scores]), np.concatenate([self.ids[asked].ravel(), ids])
        # ~s is -s - 1, which the smallest integer has, too.
        order = np.lexsort((i, ~s, rows))
        starts = np.searchsorted(rows[order], asked)
        take = order[starts[:, None] + np.arange(k)]
        self.scores[asked], self.ids[asked] = s[take], i[take]

    def beaten_by(self, q: np.ndarray | slice, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where a candidate with such a score and id would come before the kth."""
        kth, last = self.scores[q, -1], self.ids[q, -1]
        return (scores > kth) | ((scores == kth) & (ids < last))


@dataclass
class Queries:
    """Queries of one length: their numbers, own ids and vectors."""

    numbers: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    start: Best

    def __post_init__(self):
        self.doubles = self.vectors.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.doubles, self.doubles))


class BallTree:
    """Vectors ordered so that each node is a run of them; node j of a level has nodes 2j and 2j + 1 below."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        doubles, order, edges = vectors.astype(np.float64), np.arange(len(vectors)), np.array([0, len(vectors)])
        self.levels = []
        while True:
            self.levels.append(self._balls(doubles[order], ids[order], edges))
            if edges[1] - edges[0] <= LEAF:
                break
            middles = (edges[:-1] + edges[1:]) // 2
            for a, m, b in zip(edges[:-1].tolist(), middles.tolist(), edges[1:].tolist()):
                own = doubles[order[a:b]]
                one = own[np.argmax(((own - own[0]) ** 2).sum(1))]
                other = own[np.argmax(((own - one) ** 2).sum(1))]
                order[a:b] = order[a:b][np.argpartition(own @ (other - one), m - a)]
            edges = np.sort(np.concatenate([edges, middles]))
        self.edges, self.vectors, self.doubles, self.ids = edges, vectors[order], doubles[order], ids[order]
        self.largest = int(max(int(vectors.max(initial=0)), -int(vectors.min(initial=0))))

    @staticmethod
    def _balls(doubles: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and smallest ids of the runs between ``edges``."""
        sizes = np.diff(edges)
        centres = np.add.reduceat(doubles, edges[:-1]) / sizes[:, None]
        far = doubles - np.repeat(centres, sizes, 0)
        return centres, np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", far, far), edges[:-1])), np.minimum.reduceat(ids, edges[:-1])

    def _scores(self, queries: Queries, q: np.ndarray, run: slice) -> np.ndarray:
        bound = self.largest * int(np.abs(queries.vectors).max(initial=0)) * queries.vectors.shape[1]
        if bound < 1 << 53:
            return (queries.doubles[q] @ self.doubles[run].T).astype(np.int64)
        if bound < 1 << 63:
            return queries.vectors[q] @ self.vectors[run].T
        raise OverflowError("an inner product may not fit into 64 bits")

    def search(self, queries: Queries, best: Best) -> None:
        for at in range(0, len(queries.numbers), TOGETHER):
            self._search(queries, best, np.arange(at, min(at + TOGETHER, len(queries.numbers))))

    def _search(self, queries: Queries, best: Best, q: np.ndarray) -> None:
        # Bounds of (node, query), level by level; nodes without a query go, and so do queries without a node.
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(q)), bool)
        for depth, (centres, radii, least) in enumerate(self.levels):
            if depth:
                nodes, open_ = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([open_, open_])
            bound = centres[nodes] @ queries.doubles[q].T
            slack = 1e-9 * (np.abs(bound) + radii[nodes][:, None] * queries.norms[q] + 1)
            bound = np.floor(bound + radii[nodes][:, None] * queries.norms[q] + slack)
            open_ &= best.beaten_by(q, bound, least[nodes][:, None])
            some, asked = open_.any(1), open_.any(0)
            nodes, q, open_, bound = nodes[some], q[asked], open_[some][:, asked], bound[some][:, asked]
            if not len(nodes):
                return
        # The leaves in the order of each query's bounds: one in the first round, and twice as many in each further one.
        bound[~open_] = -np.inf
        order = np.argsort(-bound, axis=0, kind="stable")
        done, width = 0, 1
        while done < len(nodes):
            place, whose = np.nonzero(np.ones_like(order[done : done + width], bool))
            leaf = order[done : done + width][place, whose]
            ub = bound[leaf, whose]
            live = np.isfinite(ub) & best.beaten_by(q[whose], ub, self.levels[-1][2][nodes[leaf]])
            leaf, whose = leaf[live], whose[live]
            if not len(leaf):
                return
            by = np.argsort(leaf, kind="stable")
            leaf, whose = leaf[by], whose[by]
            hits = []
            starts = np.flatnonzero(np.diff(leaf, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
                node, asked = nodes[leaf[a]], q[whose[a:b]]
                run = slice(self.edges[node], self.edges[node + 1])
                scores, ids = self._scores(queries, asked, run), self.ids[run]
                row, column = np.nonzero(best.beaten_by(asked, scores.T, ids[:, None]).T & (queries.ids[asked][:, None] != ids))
                hits.append((asked[row], ids[column], scores[row, column]))
            best.add(*[np.concatenate(x) for x in zip(*hits)])
            done, width = done + width, 2 * width


def _searched(vectors: DataFrame, block, k: int) -> DataFrame:
    """(q, vec_id, score): for each task, what it found that may be among the best k of a query of the broadcast block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Queries] = block.value
        found = {d: Best(x.start.scores.copy(), x.start.ids.copy()) for d, x in known.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def searched(d: int) -> None:
            parts = held.pop(d)
            ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            most = max(LEAF, SHARD_BYTES // (8 * max(1, d)))
            for at in range(0, len(ids), most):
                BallTree(rows[at : at + most], ids[at : at + most]).search(known[d], found[d])

        for batch in batches:
            own = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, matrix in by_length(batch, "x"):
                d = matrix.shape[1]
                if d in known:
                    held.setdefault(d, []).append((own[rows], matrix))
                    if sum(len(p[0]) for p in held[d]) * 8 * d >= SHARD_BYTES:
                        searched(d)
        for d in list(held):
            searched(d)
        for d, best in found.items():
            # Ids of the second wave aren't among those of the first.
            new = (best.scores != _NONE) & ~(best.ids[:, :, None] == known[d].start.ids[:, None, :]).any(2)
            row, column = np.nonzero(new)
            for at in range(0, len(row), 1 << 16):
                r, c = row[at : at + (1 << 16)], column[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(known[d].numbers[r]), pa.array(best.ids[r, c]), pa.array(best.scores[r, c])], names=["q", "vec_id", "score"])

    return vectors.mapInArrow(search, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", nth).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` of the highest inner products.

    Keys are integers, vectors arrays of integers.  Queries are numbered and written to the shared folder once; a pass
    collects one block of them, of at most about ``QUERY_BYTES``, and the first wave's best k of that block.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(quoted(vector)).isNotNull()).select(F.coalesce(F.col(quoted(key)).cast("bigint"), F.lit(_LAST)).alias("id"), F.col(quoted(vector)).cast("array<bigint>").alias("x"))
    asked = queries.where(F.col(quoted(key)).isNotNull() & F.col(quoted(vector)).isNotNull()).select(F.col(quoted(key)).cast("bigint").alias("id"), F.col(quoted(vector)).cast("array<bigint>").alias("x"))
    asked = cut(asked.distinct().withColumn("q", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(8 * F.size("x") + 24 + 16 * k)).first()[0] or 0
    blocks, first = -(-size // QUERY_BYTES), F.pmod(F.xxhash64("id"), F.lit(FIRST)) == 0
    passes = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow().combine_chunks().to_batches()
        known = {m.shape[1]: Queries(x.column("q").to_numpy()[at], x.column("id").to_numpy()[at], m, Best.empty(len(at), k)) for x in held for at, m in by_length(x, "x")}
        block = spark.sparkContext.broadcast(known)
        found = cut(_best(_searched(rows.where(first), block, k), k))
        block.destroy()
        got = found.toArrow()
        q, ids, scores = (got.column(c).to_numpy() for c in ("q", "vec_id", "score"))
        for x in known.values():
            by = np.argsort(x.numbers)
            at = np.minimum(np.searchsorted(x.numbers[by], q), len(by) - 1)
            own = x.numbers[by[at]] == q
            x.start.add(by[at[own]], ids[own], scores[own])
        block = spark.sparkContext.broadcast(known)
        passes.append(cut(_best(found.drop("rank").unionByName(_searched(rows.where(~first), block, k)), k)))
        block.destroy()
    if not passes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = spark.read.schema(passes[0].schema).parquet(*[f for p in passes for f in p.inputFiles()])
    named = out.join(asked.select("q", F.col("id").alias("query_id")), "q")
    return named.select("query_id", F.col("rank").cast("int"), F.when(F.col("vec_id") != _LAST, F.col("vec_id")).alias("vec_id"), "score")


def op11_ball_tree_topk(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 100) -> DataFrame:
    vec: Column = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").where(whole(vec)).select("vec_id", scaled(vec).alias("x"))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH whole AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, c.r, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, x FROM whole WHERE vec_id % 100 = 0) q JOIN whole c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.x) = len(q.x)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
