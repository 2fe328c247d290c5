"""Exact repeats across documents, found by fixed-block anchors.

A window is ``window`` consecutive words.  A document's text is cut into non-overlapping blocks of
``(window + 1) // 2`` words, which are its anchors: every window holds one whole.  Every rolling run of as many words,
in every document, probes the anchors.  Where a probe hits an anchor of another document, both sides extend the hit:
the windows around it are hashed whole, matched, and overlapping matches join into maximal exact repeats.  Of each
repeated window the smallest document id keeps its words, and the others lose them.

Stages, each with one exchange of packed hashes (see ``grams``):

1. chunks of documents send anchors and probes to buckets by hash; what a chunk alone shows to be shared by many
   documents is answered at once and sent as one entry, so a hot passage costs each chunk one entry;
2. buckets tell the documents which of their block hashes are hit;
3. at their home buckets documents, whose texts come there packed, extend their hits to whole windows and send
   those, of each window only the smallest document id that the chunk knows;
4. buckets tell the documents which windows start in a smaller one;
5. documents, whose texts come home once more, drop the words that those windows cover.

Block hashes are cut to 31 bits and the bucket, as a false hit only costs a window's comparison; windows are compared
by 64-bit hashes.  Documents with a null id neither lose words nor make others lose any; null and empty texts have no
words; rows of equal id don't count against each other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.arrow import as_bytes, pieces
from lexweave.llm.common import table
from lexweave.llm.grams import CHUNK, MESSAGE, Outbox, WordHashes, buckets_for, by_bucket, dealt, exchanged, groups, home, rolling, row_key, tidied

WINDOW = 13
#: Documents of a chunk from which a block hash is answered without its bucket.
HOT = 8
# Kinds of messages, in the order in which a bucket reads them.
_ANCHOR, _HITS, _HOT_HITS, _WINDOWS, _SMALLER, _KNOWN, _TEXT, _DONE = range(8)
_LOW = np.uint64((1 << 31) - 1)


def _idents(blocks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 31-bit rest of block hashes."""
    return ((blocks >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), (blocks & _LOW).astype(np.uint32)


def _put_dealt(box: Outbox, kind: int, values: np.ndarray, dest: np.ndarray, owner: np.ndarray, keys: np.ndarray, docs: np.ndarray | None = None, **more) -> None:
    for to, part, who, counts in dealt(dest, owner):
        box.put(dest=to, kind=kind, a=values[part].tobytes(), b=keys[who].tobytes(), c=counts.tobytes(), d=docs[who].tobytes() if docs is not None else None, **more)


def _anchors(doc_ids: list, texts: Iterator, hasher: WordHashes, block: int, window: int) -> Iterator[tuple[int, np.ndarray]]:
    for doc_id, t in zip(doc_ids, texts):
        if doc_id is not None and t:
            h = hasher.of(t.split())
            if len(h) >= window:
                yield row_key(doc_id, t), rolling(h, block)


def _send_anchors(box: Outbox, keys: list[int], blocks: list[np.ndarray], block: int, buckets: int) -> None:
    lens = np.array([len(x) for x in blocks])
    owner, key = np.repeat(np.arange(len(blocks)), lens), np.array(keys, np.int64)
    every = np.concatenate(blocks)
    place = np.arange(len(every)) - np.repeat(np.cumsum(lens) - lens, lens)
    anchor = place % block == 0
    order = np.argsort(every, kind="stable")
    starts, ends = groups(every[order])
    hot = np.flatnonzero(ends - starts >= HOT)
    hot = hot[[len(np.unique(owner[order[starts[g] : ends[g]]])) >= HOT for g in hot]] if len(hot) else hot
    send = np.ones(len(every), bool)
    if len(hot):
        known = np.sort(np.concatenate([order[starts[g] : ends[g]] for g in hot]))
        send[known] = False
        first = order[starts[hot]]
        send[first] = anchor[first] = True
        _put_dealt(box, _HOT_HITS, every[known], home(key[owner[known]], buckets), owner[known], key)
    bucket, low = _idents(every[send], buckets)
    _put_dealt(box, _ANCHOR, (low << np.uint32(1)) | anchor[send].astype(np.uint32), bucket, owner[send], key)


class _Inbox:
    """Entries that came to one destination."""

    def __init__(self, dtype: type):
        self.dtype = dtype
        self.values, self.keys, self.counts, self.docs = [], [], [], []

    def add(self, m: dict) -> None:
        self.values.append(np.frombuffer(m["a"], self.dtype))
        self.keys.append(np.frombuffer(m["b"], np.int64))
        self.counts.append(np.frombuffer(m["c"], np.uint32))
        if m["d"] is not None:
            self.docs.append(np.frombuffer(m["d"], np.int64))

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Values, number of each value's owner, the owners' keys and their documents."""
        counts = np.concatenate(self.counts)
        return np.concatenate(self.values), np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.concatenate(self.keys), np.concatenate(self.docs) if self.docs else None


def _answer_anchors(box: Outbox, bucket: int, inbox: _Inbox, buckets: int) -> None:
    codes, owner, keys, _ = inbox.all()
    order = np.argsort(codes >> np.uint32(1), kind="stable")
    low = codes[order] >> np.uint32(1)
    starts, ends = groups(low)
    anchored = np.maximum.reduceat(codes[order] & np.uint32(1), starts) > 0
    key = keys[owner[order]]
    # Repeated rows have equal keys and come in any order among others: a block is shared if any two keys differ.
    hit = anchored & (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts))
    mine = np.sort(order[np.repeat(hit, ends - starts)])
    if len(mine):
        _put_dealt(box, _HITS, codes[mine] >> np.uint32(1), home(keys[owner[mine]], buckets), owner[mine], keys, n=bucket)


def _answer_windows(box: Outbox, inbox: _Inbox, buckets: int) -> None:
    hashes, owner, keys, docs = inbox.all()
    order = np.argsort(hashes, kind="stable")
    starts, ends = groups(hashes[order])
    doc = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, starts), ends - starts)
    mine = np.sort(order[doc > least])
    if len(mine):
        _put_dealt(box, _SMALLER, hashes[mine], home(keys[owner[mine]], buckets), owner[mine], keys)


def _by_key(into: dict[int, list[np.ndarray]], m: dict, values: np.ndarray) -> None:
    at = np.cumsum(np.frombuffer(m["c"], np.uint32))[:-1]
    for key, part in zip(np.frombuffer(m["b"], np.int64).tolist(), np.split(values, at)):
        into[key].append(part)


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in windows that start at ``starts`` (booleans)."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _done(box: Outbox, dest: int, doc_id: int | None, words: list[bytes], gone: np.ndarray | None, texts: bool) -> None:
    kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone is not None else b" ".join(words)
    box.put(dest=dest, kind=_DONE, doc=doc_id, n=len(words), m=int(gone.sum()) if gone is not None else 0, a=kept if texts else hashlib.sha256(kept).hexdigest().encode())


def repeats_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row: kept words joined by one space, or with texts=False their SHA-256."""
    block, buckets = (window + 1) // 2, buckets_for(docs)
    some = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    @tidied
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, box, keys, blocks, size = WordHashes(), Outbox(), [], [], 0
        for batch in pieces(batches, "text"):
            for k, b in _anchors(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), hasher, block, window):
                keys.append(k)
                blocks.append(b)
                size += len(b)
                if size >= CHUNK:
                    _send_anchors(box, keys, blocks, block, buckets)
                    keys, blocks, size = [], [], 0
                    yield from box.full()
        if keys:
            _send_anchors(box, keys, blocks, block, buckets)
        yield from box.rest()

    @tidied
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox()
        for bucket, rows in by_bucket(batches):
            anchors, windows = _Inbox(np.uint32), _Inbox(np.uint64)
            for m in rows:
                if m["kind"] == _ANCHOR:
                    anchors.add(m)
                elif m["kind"] == _WINDOWS:
                    windows.add(m)
                else:
                    box.put(**m)
                    yield from box.full()
            if anchors.values:
                _answer_anchors(box, bucket, anchors, buckets)
            if windows.values:
                _answer_windows(box, windows, buckets)
            yield from box.full()
        yield from box.rest()

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, press = Outbox(), zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                k = row_key(doc_id, t or b"")
                box.put(dest=int(home(np.array([k]), buckets)[0]), kind=_TEXT, doc=doc_id, key=k, a=press.compress(t or b""))
                yield from box.full()
        yield from box.rest()

    @tidied
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, box, unpress = WordHashes(), Outbox(), zstandard.ZstdDecompressor()
        held: list[dict] = []
        hashes: list[np.ndarray] = []
        whole: list[np.ndarray] = []
        size = 0

        def send() -> None:
            owner = np.repeat(np.arange(len(held)), [len(h) for h in hashes])
            every, docs_, keys = np.concatenate(hashes), np.array([m["doc"] for m in held], np.int64), np.array([m["key"] for m in held], np.int64)
            order = np.lexsort((docs_[owner], every))
            starts, ends = groups(every[order])
            least = np.empty(len(every), np.int64)
            least[order] = np.repeat(docs_[owner[order[starts]]], ends - starts)
            smaller = docs_[owner] > least
            _put_dealt(box, _WINDOWS, every[~smaller], _idents(every[~smaller], buckets)[0], owner[~smaller], keys, docs_)
            for m, s, h, w in zip(held, np.split(smaller, np.cumsum([len(h) for h in hashes])[:-1]), hashes, whole):
                if s.any():
                    gone = np.isin(w, h[s])
                    box.put(dest=m["dest"], kind=_KNOWN, key=m["key"], a=np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).astype(np.uint32).tobytes())

        for _, rows in by_bucket(batches):
            hits: dict[int, list[np.ndarray]] = defaultdict(list)
            for m in rows:
                if m["kind"] == _HITS:
                    _by_key(hits, m, np.frombuffer(m["a"], np.uint32).astype(np.uint64) | np.uint64(m["n"] << 31))
                elif m["kind"] == _HOT_HITS:
                    bucket, low = _idents(np.frombuffer(m["a"], np.uint64), buckets)
                    _by_key(hits, m, low.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(31)))
                elif m["key"] in hits:
                    h = hasher.of(unpress.decompress(m["a"]).split())
                    bucket, low = _idents(rolling(h, block), buckets)
                    at = np.flatnonzero(np.isin(low.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(31)), np.concatenate(hits[m["key"]])))
                    n = len(h) - window + 1
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, np.clip(at - (window - block), 0, n), 1)
                    np.add.at(edge, np.clip(at + 1, 0, n), -1)
                    windows = rolling(h, window)
                    active = np.unique(windows[np.cumsum(edge[:-1]) > 0])
                    if len(active):
                        held.append({x: m[x] for x in ("dest", "key", "doc")})
                        hashes.append(active)
                        whole.append(windows)
                        size += len(windows)
                    if size >= CHUNK:
                        send()
                        held, hashes, whole, size = [], [], [], 0
                    yield from box.full()
        if held:
            send()
        yield from box.rest()

    @tidied
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, box, unpress = WordHashes(), Outbox(), zstandard.ZstdDecompressor()
        for _, rows in by_bucket(batches):
            smaller: dict[int, list[np.ndarray]] = defaultdict(list)
            known: dict[int, np.ndarray] = {}
            for m in rows:
                if m["kind"] == _SMALLER:
                    _by_key(smaller, m, np.frombuffer(m["a"], np.uint64))
                elif m["kind"] == _KNOWN:
                    known[m["key"]] = np.frombuffer(m["a"], np.uint32).reshape(-1, 2)
                else:
                    words, gone = unpress.decompress(m["a"]).split(), None
                    if m["key"] in smaller or m["key"] in known:
                        starts = np.zeros(len(words) - window + 1, bool)
                        if m["key"] in smaller:
                            starts |= np.isin(rolling(hasher.of(words), window), np.concatenate(smaller[m["key"]]))
                        for a, b in known.get(m["key"], ()):
                            starts[a:b] = True
                        gone = _covered(starts, len(words), window)
                    _done(box, m["dest"], m["doc"], words, gone, texts)
                    yield from box.full()
        yield from box.rest()

    packed = some.mapInArrow(pack, MESSAGE)
    told = exchanged(some.mapInArrow(ask, MESSAGE), buckets).mapInArrow(answer, MESSAGE)
    judged = exchanged(told.unionByName(packed), buckets, kinds=True).mapInArrow(extend, MESSAGE)
    settled = exchanged(judged, buckets).mapInArrow(answer, MESSAGE)
    done = exchanged(settled.unionByName(packed), buckets, kinds=True).mapInArrow(drop, MESSAGE)
    return done.select(F.col("doc").alias(key), F.col("n").alias("n_words"), F.col("m").alias("n_removed"), F.decode("a", "UTF-8").alias("kept"))


def op10_block_anchor_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)
), least_doc AS (SELECT gram, min(doc_id) AS least_id FROM pos GROUP BY gram
), gone AS (SELECT DISTINCT doc_id, p + o AS i FROM (SELECT doc_id, p, unnest(range(0, 13)) AS o FROM pos JOIN least_doc USING (gram) WHERE least_id < doc_id)
), every AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
