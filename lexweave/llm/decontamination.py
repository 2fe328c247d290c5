"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words are put into one suffix automaton (in blocks of a bounded number of words).  A document's
words are streamed through it, which gives at each word the longest match that ends there.  A window is ``window``
consecutive words of an item, or a whole item that has fewer; a word inside an occurrence of a window is hit.

Words that lie in no run of item word pairs can't be inside a window, so the automaton is stepped through such runs
only; that changes nothing in the result.

Each document is looked at on its own: no shuffle.  Items come to the driver one by one and make automata of at most
``BLOCK_WORDS`` words, or of one item, each built in turn and packed into arrays of some 100 bytes a word.  Automata of
up to ``PASS_WORDS`` words are broadcast together.  A larger benchmark makes several passes: what a pass found is
written to the shared folder, its broadcast destroyed, and the next pass adds to it.  So no broadcast, and no worker,
holds more than a pass, however large the benchmark is.

Defined cases: null texts have no words; items without words or with a null text make no window; an item with a null id
hits words but isn't reported; items of equal id count once; repeated documents are judged alike; empty tables give no
hits or no rows; further columns are kept, and a column named like a new one is replaced.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.arrow import as_bytes, extended, pieces, with_fields
from lexweave.llm.common import Held, cut, table

WINDOW = 10
#: Building an automaton of so many words takes some 150 MB of the driver's memory; packed, it takes some 20 MB.
BLOCK_WORDS = 200_000
#: Words of the automata that are broadcast together: some 200 MB at most.
PASS_WORDS = 2_000_000
#: A document loses its hit spans; with more than this share of its words hit it is dropped.
MAX_COVERAGE = 0.5
_PAIRS = 1 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(c if c > 127 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose letters A to Z are made small."""
    return text.translate(_NORMAL).split() if text else []


class _Growing:
    """A suffix automaton while sequences of word numbers are put into it."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = array("i", [-1]), array("i", [0])

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the matches of q that p leads to, apart from longer ones."""
        if self.size[p] + 1 == self.size[q]:
            return q
        copy = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c, self.step[last][c])
        new = self._new(self.size[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, c, self.step[p][c])
        return new


def _found(keys: array, key: int) -> int:
    """Place of a key in a sorted array, -1 if it isn't there."""
    at = bisect_left(keys, key)
    return at if at < len(keys) and keys[at] == key else -1


class SuffixAutomaton:
    """Of several word sequences; knows which windows of which items end in each state.  Everything is in flat arrays."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: list[str] = []
        grown = _Growing()
        coded = [(item, array("i", [self.ids.setdefault(w, len(self.ids)) for w in ws])) for item, ws in items if ws]
        self.n_words = sum(len(seq) for _, seq in coded)
        for _, seq in coded:
            last = 0
            for c in seq:
                last = grown.extend(last, c)
        self.link, self.size = grown.link, grown.size
        #: (state, word) as one number, ascending, and the state each leads to.
        self.width = len(self.ids) + 1
        pairs = sorted((state * self.width + c, to) for state, step in enumerate(grown.step) for c, to in step.items())
        self.steps, self.to = array("q", [x for x, _ in pairs]), array("i", [x for _, x in pairs])
        del grown, pairs
        self.pairs, windows, names = np.zeros(_PAIRS, bool), set(), {}
        for item, seq in coded:
            k = min(window, len(seq))
            name = -1 if item is None else names.setdefault(item, len(names))
            state = n = 0
            for c in seq:
                state, n = self._step(state, c), n + 1
                if n >= k:
                    n = k
                    state = self._shortened(state, k)
                    windows.add((state * (window + 1) + k, name))
            a = np.frombuffer(seq, np.int32).astype(np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
        self.items = list(names)
        ordered = sorted(windows)
        #: (state, length) of each window as one number, ascending, once for each item that has it, and those items.
        self.window, self.of = window, array("i", [x for _, x in ordered])
        self.windows = array("q", [x for x, _ in ordered])
        self.lengths = sorted({x % (window + 1) for x in self.windows})

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & (_PAIRS - 1)

    def _step(self, state: int, c: int) -> int:
        """The state that a word leads to, -1 if none."""
        at = _found(self.steps, state * self.width + c)
        return self.to[at] if at >= 0 else -1

    def _shortened(self, state: int, k: int) -> int:
        """The state of the last k words of what is matched in ``state``."""
        while self.size[self.link[state]] >= k:
            state = self.link[state]
        return state

    def _window(self, state: int, k: int) -> set[str] | None:
        """The items with a window of k words there, None if there is none."""
        key = state * (self.window + 1) + k
        at = _found(self.windows, key)
        if at < 0:
            return None
        out = set()
        while at < len(self.windows) and self.windows[at] == key:
            if self.of[at] >= 0:
                out.add(self.items[self.of[at]])
            at += 1
        return out

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words outside of which no window can lie."""
        least = self.lengths[0]
        if len(ids) < least:
            return []
        if least == 1:
            return [(0, len(ids))]
        known = ids >= 0
        pair = known[:-1] & known[1:]
        pair &= self.pairs[self._pair(ids[:-1], ids[1:])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], pair.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least - 1
        return [(int(a), int(b) + 1) for a, b in zip(starts[long], ends[long])]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words, in order and apart, and the items whose windows occur."""
        ranges: list[list[int]] = []
        items: set[str] = set()
        if not self.lengths or not words:
            return [], items
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        for begin, end in self._runs(ids):
            state = n = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin):
                to = self._step(state, c)
                while state and to < 0:
                    state = self.link[state]
                    n = self.size[state]
                    to = self._step(state, c)
                if to < 0:
                    continue
                state, n = to, n + 1
                longest = 0
                for k in self.lengths:
                    if k > n:
                        break
                    found = self._window(self._shortened(state, k), k)
                    if found is not None:
                        longest = k
                        items |= found
                if longest:
                    start = i + 1 - longest
                    while ranges and ranges[-1][0] >= start:
                        ranges.pop()
                    if ranges and ranges[-1][1] >= start:
                        ranges[-1][1] = i + 1
                    else:
                        ranges.append([start, i + 1])
        return [(a, b) for a, b in ranges], items


def automata(items: DataFrame, key: str, text: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of the items, each of ``block_words`` words or of one item; the items come to the driver one by one."""
    some = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    block, n = [], 0
    for row in some.toLocalIterator():
        words = normal_words(row["t"].encode())
        if block and n + len(words) > block_words:
            yield SuffixAutomaton(block, window)
            block, n = [], 0
        block.append((row["k"], words))
        n += len(words)
    if block:
        yield SuffixAutomaton(block, window)


def _passes(blocks: Iterator[SuffixAutomaton], most: int) -> Iterator[tuple[list[SuffixAutomaton], bool]]:
    """Automata of up to ``most`` words together, and whether they are the last; one empty list if there are none."""
    held, n = [], 0
    for a in blocks:
        if held and n + a.n_words > most:
            yield held, False
            held, n = [], 0
        held.append(a)
        n += a.n_words
    yield held, True


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without what reaches from the first to the last word of each range."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(_SPAN))]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(_SPAN))]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, cleaned: str | None = None, min_span: int = 1, pass_words: int = PASS_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (their ids, sorted as strings) and hit_spans (ranges of words, end exclusive).

    cleaned: a column for the text without those hit spans that have ``min_span`` words or more.
    """
    safe, held = Held(docs, None, text), None
    out = safe.rows
    for some, last in _passes(automata(items, item_key, item_text, window, block_words), pass_words):
        again = held is not None
        if again:
            out = cut(out)
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(some)
        out = _pass(out, held, again, last and cleaned is not None, min_span)
    if cleaned is not None:
        out = out.withColumnRenamed("clean", cleaned)
    return safe.back(out, [f.name for f in _FOUND] + ([cleaned] if cleaned is not None else []))


def _pass(rows: DataFrame, held: Broadcast, again: bool, clean: bool, min_span: int) -> DataFrame:
    """Rows (t, rest) with what some automata find; again: besides what earlier ones found; clean: and the text without it."""
    fields = _FOUND + ([T.StructField("clean", T.StringType())] if clean else [])
    schema = with_fields(rows.schema, fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            out: dict[str, list] = {f.name: [] for f in fields}
            before = zip(batch.column("hit_items").to_pylist(), batch.column("hit_spans").to_pylist()) if again else repeat(((), ()))
            for t, (old_items, old_spans) in zip(as_bytes(batch.column("t")), before):
                words = normal_words(t)
                ranges, found = [(s["start"], s["end"]) for s in old_spans], set(old_items)
                for a in held.value:
                    r, f = a.hits(words)
                    ranges += r
                    found |= f
                ranges = merged(ranges)
                out["n_words"].append(len(words))
                out["n_hit"].append(sum(b - a for a, b in ranges))
                out["hit_items"].append(sorted(found))
                out["hit_spans"].append([{"start": a, "end": b} for a, b in ranges])
                if clean:
                    gone = [(a, b) for a, b in ranges if b - a >= min_span]
                    out["clean"].append(without(t.decode(), gone) if gone else t)
            yield extended(batch, schema, out)

    return rows.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, min_span: int = 1, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without hit spans of ``min_span`` words or more, and without documents hit beyond ``max_coverage``."""
    held = Held(docs, None, text)
    found = find_contamination(held.rows, items, "t", window=window, cleaned="clean", min_span=min_span)
    return held.back(found.where(F.col("n_hit") <= max_coverage * F.col("n_words")).select("rest", F.col("clean").alias("t")))


def op1_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS gram
  FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM win
), pos AS (
  SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, ks WHERE len(ws) >= k)
), hit AS (SELECT DISTINCT doc_id, k, p, item_id FROM pos JOIN win USING (k, gram)
), words AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, k)) AS o FROM hit) GROUP BY doc_id
), found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
