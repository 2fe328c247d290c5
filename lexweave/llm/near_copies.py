"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set is its distinct five-word shingles.  Two documents link when their sets' Jaccard similarity is 0.8 or
more.  All tokens (shingles) are put in one order, rarest first.  Of a set of n tokens, of which a partner must share
``o = ceil(0.8 n)``, the prefix of level l is its first ``n - o + l`` tokens; partners share at least l tokens of their
level-l prefixes.  A document's level is the one of the least estimated cost: reading the postings of its prefix's
tokens, and comparing the candidates that are in l of them or more, of which there are an l-th of the postings at most.
So the dearer the candidates, the longer the prefix and the more matches a pair needs (the lower of its two levels).

Steps:

1. Documents of equal sets form classes.  In the same pass, tokens that a chunk of documents repeats are counted, and
   the ``FREQUENT`` most frequent of them make the end of the order; they are broadcast, as their number is bounded.
2. All other tokens are dealt to buckets as packed hashes (see ``grams``), which count each token's classes and answer
   for tokens of two or more.  Tokens of one class come first in the order, so a class with as many of them as its
   prefix is long has no partner and is done; nearly all classes are.  The rest choose their levels.
3. Every token of a level's prefix names the class with the fewest tokens of its own as its leader, the likeliest
   original; classes are compared with their leaders first, and links joined into components.
4. Then the lengthened prefixes are joined by token, between classes that are still in different components and of
   sizes that can link, and matches counted; pairs with as many as the lower of their levels have their sets fetched
   and compared.  A token that many classes share is dealt out over cells of at most ``CELL`` by ``CELL`` classes.  A
   large group of near copies is one component by then and makes no pairs; no pair that could join two components is
   left out.

Links are compared by 44-bit hashes within a bucket.  Cases: null, empty and blank texts have no shingles and link with
nothing; with one to four words the whole sequence is the one shingle; a row with a null id is in no component (null);
repeated rows and equal texts share a component; an empty table gives an empty table; other columns are ignored.  Ids
are integers: others raise an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexweave.llm.arrow import as_bytes, pieces
from lexweave.llm.common import cut, table
from lexweave.llm.components import components
from lexweave.llm.grams import CHUNK, MESSAGE, Outbox, WordHashes, buckets_for, by_bucket, dealt, exchanged, groups, home, rolling, rows_of, tidied

SHINGLE = 5
#: Tokens in so many documents of a chunk may be frequent, and so many at most are.
REPEATED, FREQUENT = 8, 200_000
#: Levels at most, and the tokens of two sets that are compared at the cost of one posting.
LEVELS, COMPARED = 4, 8
#: Classes of a token that meet as many others in one task.
CELL = 2_000
#: Leaders with which a class is compared before all others.
LEADERS = 3
_DESCRIBED, _REPEATED, _ASKED, _SHARED, _OWN = range(5)
_BITS = 44
_LOW = np.uint64((1 << _BITS) - 1)


class Shingler:
    def __init__(self, buckets: int):
        self.hasher, self.buckets = WordHashes(), np.uint64(buckets)

    def tokens(self, text: bytes | None) -> np.ndarray:
        """A text's set: bucket and 44 bits of each distinct shingle, ascending."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        grams = rolling(self.hasher.of(words), SHINGLE) if len(words) >= SHINGLE else np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        return np.unique(((grams >> np.uint64(_BITS)) % self.buckets) << np.uint64(_BITS) | grams & _LOW)


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n: int) -> int:
    """Tokens that a partner of a set of n must share."""
    return -(-4 * n // 5)


def best_level(sizes: np.ndarray, slots: int, n: int) -> int:
    """The level of the least cost; sizes: postings of a set's shared tokens in order, of which level 1 has ``slots``."""
    most = min(LEVELS, needed(n), len(sizes) - slots + 1)
    read = np.cumsum(sizes)
    return min(range(1, most + 1), key=lambda level: read[slots + level - 2] * (1 + n / COMPARED / level))


def _chunks(batches: Iterator[pa.RecordBatch], shingler: Shingler) -> Iterator[tuple[list, list]]:
    """Chunks of (doc, class, number of tokens) and of (class, tokens), each class once."""
    seen: set[int] = set()
    rows, sets, size = [], [], 0
    for batch in pieces(batches, "text"):
        for doc, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
            tokens = shingler.tokens(t)
            c = class_of(tokens)
            rows.append((doc, c, len(tokens)))
            if len(tokens) and doc is not None and c not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                sets.append((c, tokens))
                size += len(tokens)
            if size >= CHUNK or len(rows) >= 50_000:
                yield rows, sets
                rows, sets, size = [], [], 0
    if rows:
        yield rows, sets


def _described(docs: DataFrame, buckets: int) -> DataFrame:
    @tidied
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox()
        for rows, sets in _chunks(batches, Shingler(buckets)):
            for doc, c, n in rows:
                box.put(kind=_DESCRIBED, doc=doc, key=c, n=n)
            if sets:
                tokens, counts = np.unique(np.concatenate([t for _, t in sets]), return_counts=True)
                again = counts >= REPEATED
                if again.any():
                    box.put(kind=_REPEATED, a=tokens[again].tobytes(), c=counts[again].astype(np.int64).tobytes())
            yield from box.full()
        yield from box.rest()

    return cut(docs.mapInArrow(describe, MESSAGE))


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, rarest first, and their counts; at most FREQUENT, whatever the corpus."""

    @tidied
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(m["a"], np.int64)), pa.array(np.frombuffer(m["c"], np.int64))], ["token", "count"])

    counts = described.where(F.col("kind") == _REPEATED).mapInArrow(spread, "token bigint, count bigint").groupBy("token").agg(F.sum("count").alias("count"))
    rows = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    return rows.column("token").to_numpy().view(np.uint64)[::-1].copy(), np.minimum(rows.column("count").to_numpy()[::-1], (1 << 32) - 1).astype(np.uint32)


def _packed(tokens: np.ndarray, classes: np.ndarray | None = None) -> bytes:
    low = tokens & _LOW
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint16).tobytes() + (classes.tobytes() if classes is not None else b"")


def _unpacked(raw: bytes, bucket: int, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    k = len(raw) // (7 if counted else 6)
    low = np.frombuffer(raw, np.uint32, k).astype(np.uint64) | np.frombuffer(raw, np.uint16, k, 4 * k).astype(np.uint64) << np.uint64(32)
    return low | np.uint64(bucket << _BITS), np.frombuffer(raw, np.uint8, k, 6 * k) if counted else None


def _sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Classes that may have a partner: key, n tokens, m tokens of its own, level, and its shared tokens in order (a)."""
    order = np.argsort(frequent[0])
    held = docs.sparkSession.sparkContext.broadcast((frequent[0][order], order, frequent[1][order]))

    @tidied
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, (known, rank, count) = Outbox(), held.value
        for _, sets in _chunks(batches, Shingler(buckets)):
            if not sets:
                continue
            every, keys = np.concatenate([t for _, t in sets]), np.array([c for c, _ in sets], np.int64)
            lens = np.array([len(t) for _, t in sets])
            owner = np.repeat(np.arange(len(sets)), lens)
            at = np.searchsorted(known, every)
            often = known[np.minimum(at, len(known) - 1)] == every if len(known) else np.zeros(len(every), bool)
            edges = np.concatenate(([0], np.cumsum(np.bincount(owner[often], minlength=len(sets)))))
            # Frequent tokens are named by their place in the order.
            ranks, counts = rank[at[often]].astype(np.uint32), count[at[often]]
            homes = home(keys, buckets)
            for i, c in enumerate(keys.tolist()):
                box.put(dest=int(homes[i]), kind=_OWN, key=c, n=int(lens[i]), a=ranks[edges[i] : edges[i + 1]].tobytes(), b=counts[edges[i] : edges[i + 1]].tobytes())
            rest, who = every[~often], owner[~often]
            for to, part, whose, counts in dealt((rest >> np.uint64(_BITS)).astype(np.int64), who):
                box.put(dest=to, kind=_ASKED, a=_packed(rest[part]), b=keys[whose].tobytes(), c=counts.tobytes())
            yield from box.full()
        yield from box.rest()

    @tidied
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox()
        for bucket, rows in by_bucket(batches):
            parts = []
            for m in rows:
                if m["kind"] == _ASKED:
                    parts.append((_unpacked(m["a"], bucket, False)[0], np.frombuffer(m["b"], np.int64), np.frombuffer(m["c"], np.uint32)))
                else:
                    box.put(**m)
                    yield from box.full()
            if not parts:
                continue
            tokens = np.concatenate([p[0] for p in parts])
            keys, which = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            owner = np.repeat(which, np.concatenate([p[2] for p in parts]))
            del parts
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            once = np.ones(len(tokens), bool)
            once[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            tokens, owner = tokens[once], owner[once]
            starts, ends = groups(tokens)
            size = np.repeat(ends - starts, ends - starts)
            shared = size > 1
            tokens, owner, size = tokens[shared], owner[shared], np.minimum(size[shared], 255).astype(np.uint8)
            order = np.argsort(owner, kind="stable")
            tokens, owner, size = tokens[order], owner[order], size[order]
            for to, part, whose, counts in dealt(home(keys[owner], buckets), owner):
                box.put(dest=to, kind=_SHARED, n=bucket, a=_packed(tokens[part], size[part]), b=keys[whose].tobytes(), c=counts.tobytes())
            yield from box.full()
        yield from box.rest()

    @tidied
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox()
        for _, rows in by_bucket(batches):
            own, shared = {}, defaultdict(list)
            for m in rows:
                if m["kind"] == _OWN:
                    own[m["key"]] = (m["n"], np.frombuffer(m["a"], np.uint32), np.frombuffer(m["b"], np.uint32))
                else:
                    tokens, sizes = _unpacked(m["a"], m["n"], True)
                    at = np.cumsum(np.frombuffer(m["c"], np.uint32))[:-1]
                    for key, t, s in zip(np.frombuffer(m["b"], np.int64).tolist(), np.split(tokens, at), np.split(sizes, at)):
                        shared[key].append((t, s))
            for key, (n, ranks, counts) in own.items():
                parts = shared.pop(key, [])
                alone = n - len(ranks) - sum(len(t) for t, _ in parts)
                slots = n - needed(n) + 1 - alone
                if slots <= 0:
                    continue
                tokens = np.concatenate([np.empty(0, np.uint64), *[t for t, _ in parts]])
                sizes = np.concatenate([np.empty(0, np.uint8), *[s for _, s in parts]])
                order, last = np.lexsort((tokens, sizes)), np.argsort(ranks)
                # The order ends with the frequent tokens; their names are above all others'.
                tokens = np.concatenate((tokens[order], ranks[last].astype(np.uint64) | np.uint64(0xFFFFF << _BITS)))
                sizes = np.concatenate((sizes[order].astype(np.int64), counts[last].astype(np.int64)))
                box.put(kind=best_level(sizes, slots, n), key=key, n=n, m=alone, a=tokens.tobytes())
                yield from box.full()
        yield from box.rest()

    told = exchanged(docs.mapInArrow(ask, MESSAGE), buckets).mapInArrow(answer, MESSAGE)
    done = exchanged(told, buckets).mapInArrow(assemble, MESSAGE)
    return cut(done.select("key", "n", "m", F.col("kind").alias("level"), "a"))


def _prefixes(sets: DataFrame) -> DataFrame:
    """(token, key, n, m, level, place): a row for each shared token of each class's prefix, with its place in the order."""

    @tidied
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, m, level, a in zip(*[batch.column(x).to_pylist() for x in ("key", "n", "m", "level", "a")]):
                tokens = np.frombuffer(a, np.int64)[: n - needed(n) + level - m]
                k = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *[pa.array(np.full(k, v)) for v in (key, n, m, level)], pa.array(np.arange(m, m + k))], ["token", "key", "n", "m", "level", "place"])

    return sets.mapInArrow(spread, "token bigint, key bigint, n bigint, m bigint, level bigint, place bigint")


def _level(x: str, y: str) -> Column:
    return F.least(f"level_{x}", f"level_{y}")


def _in_prefixes(x: str, y: str) -> Column:
    """Whether a shared token lies in both prefixes for just this pair, and the two can share enough beside it.

    What they must share follows from their sizes.  As all sets have one order, tokens before the shared one can only
    match tokens before it, of which those of one class alone match none, and tokens after it tokens after it.
    """
    share = F.ceil(80 * (F.col(f"n_{x}") + F.col(f"n_{y}")) / F.lit(180))
    near = 100 * F.least(f"n_{x}", f"n_{y}") >= 80 * F.greatest(f"n_{x}", f"n_{y}")
    before = F.least(*[F.col(f"place_{c}") - F.col(f"m_{c}") for c in (x, y)])
    after = F.least(*[F.col(f"n_{c}") - F.col(f"place_{c}") for c in (x, y)])
    return near & (before + after >= share) & (F.col(f"place_{x}") < F.col(f"n_{x}") - share + _level(x, y)) & (F.col(f"place_{y}") < F.col(f"n_{y}") - share + _level(x, y))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (x, y) whose sets' similarity is 0.8 or more; only now are whole sets fetched."""

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny = [batch.column(c).to_numpy() for c in ("x", "y", "n_x", "n_y")]
            a, b = batch.column("a_x"), batch.column("a_y")
            good = np.zeros(len(x), bool)
            for i in range(len(x)):
                s, t = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                good[i] = len(np.intersect1d(s, t, assume_unique=True)) >= -(-80 * int(nx[i] + ny[i]) // 180)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good])], ["x", "y"])

    left, right = [sets.select(F.col("key").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("n", "a")]) for p in "xy"]
    return pairs.select("x", "y").join(left, "x").join(right, "y").mapInArrow(compare, "x bigint, y bigint")


def _leader_pairs(prefixes: DataFrame) -> DataFrame:
    best = F.min(F.struct((F.col("m") / F.col("n")).alias("own"), "key", "n", "m", "level", "place")).alias("l")
    leaders = prefixes.groupBy("token").agg(best, F.count(F.lit(1)).alias("of")).where("of > 1").select("token", F.col("l.key").alias("y"), *[F.col(f"l.{c}").alias(f"{c}_y") for c in ("n", "m", "level", "place")])
    rows = prefixes.select("token", F.col("key").alias("x"), *[F.col(c).alias(f"{c}_x") for c in ("n", "m", "level", "place")])
    votes = rows.join(leaders, "token").where((F.col("x") != F.col("y")) & _in_prefixes("x", "y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("votes"), "y"))  # at most as many rows as a prefix has tokens
    return votes.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select("x", "y")


def _other_pairs(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of classes in different components that match as often as the lower of their levels asks for.

    Of each token's components the largest is its main one, within which no pairs are made: one class of a pair is always
    outside.  Sizes of classes lie in bands of a quarter, so that classes of sizes that can link are in the same or
    neighbouring ones.
    """
    named = prefixes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("of"))
    split = parts.groupBy("token").agg(F.max(F.struct("of", "root")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("top.root").alias("main"))
    rows = cut(named.join(split, "token").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")))
    columns = ("key", "n", "m", "level", "place", "root")
    outside = rows.where("root <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    cells = [df.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).alias(c)) for df, c in ((outside, "cells_x"), (rows, "cells_y"))]
    # Written before it is joined, so that Spark can split the rows of a token that many classes share.
    grid = cut(cells[0].join(cells[1], ["token", "band"]))
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    x = outside.join(grid.hint("merge"), ["token", "band"]).select("token", "band", part("cells_x").alias("i"), every("cells_y").alias("j"), *[F.col(c).alias(f"{c}_x") for c in columns])
    y = rows.join(grid.hint("merge"), ["token", "band"]).select("token", "band", every("cells_x").alias("i"), part("cells_y").alias("j"), *[F.col(c).alias(f"{c}_y") for c in columns], (F.col("root") == F.col("main")).alias("main_y"))
    apart = (F.col("root_x") != F.col("root_y")) & (F.col("main_y") | (F.col("key_x") < F.col("key_y")))
    met = x.join(y, ["token", "band", "i", "j"]).where(apart & _in_prefixes("x", "y"))
    counted = met.groupBy(F.least("key_x", "key_y").alias("x"), F.greatest("key_x", "key_y").alias("y")).agg(F.count(F.lit(1)).alias("matches"), F.min(_level("x", "y")).alias("level"))
    return counted.where("matches >= level").select("x", "y")


def near_copy_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row: component_id is the smallest key reachable by links."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"ids must be integers; {key} is {docs.schema[key].dataType.simpleString()}")
    buckets = buckets_for(docs)
    some = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    described = _described(some, buckets)
    sets = _sets(some, _frequent(described), buckets)
    prefixes = _prefixes(sets)
    first = cut(_links(_leader_pairs(prefixes), sets))
    links = first.union(_links(_other_pairs(prefixes, components(first)), sets))
    roots = components(cut(links))
    rows = described.where(F.col("kind") == _DESCRIBED).select("doc", "key", "n")
    # Rows without shingles or id all have one class, or none: they stay out of the joins.  These are merge joins, as
    # there are as many classes as documents, which Spark may take for few and broadcast.
    linked, rest = rows.where("n > 0 AND doc IS NOT NULL"), rows.where("n = 0 OR doc IS NULL")
    classes = linked.groupBy("key").agg(F.min("doc").alias("least"))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    # Written before it is joined, so that Spark can split a component that holds a large part of all classes.
    smallest = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = rooted.join(smallest.hint("merge"), "root").select("key", "component_id")
    out = linked.join(of_class.hint("merge"), "key").select("doc", "n", "component_id").unionByName(rest.select("doc", "n", F.col("doc").alias("component_id")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op6_adaptive_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT x AS node, x AS root FROM links UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.node WHERE r.root < b.y
), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(root, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN roots ON node = w.doc_id
"""
