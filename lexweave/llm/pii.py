"""Personal data: patterns, and a skip-chain conditional random field that carries their labels through a document.

Patterns find the base spans (email, ip, card, phone).  The parts of a text's words that hold a digit or an @ are the
nodes of a random field whose labels are the four kinds and "other".  Nodes that meet base spans are observed (of the
kind that covers most of them), and those that meet one and the same are one node.  Potentials:

* of a node: a weight of each label for each shape of word, and one for any shape;
* of neighbours parted by one blank: a weight for each two labels;
* of distant nodes that are the same or similar (same last seven digits, or same name part): a weight for each two
  labels.  Each node is linked with the next one like it.

The weights are those of the greatest composite pseudo-likelihood of all documents: of each node's label given its shape
and its neighbours' labels, or parts of these, less ``DECAY`` times half the squares of the weights.  What it needs of
the corpus is how often each combination of a shape, a label and neighbours' labels occurs; these counts are added up in
each batch before they are shuffled.  Labels come from the patterns, which has two consequences.  A node that no pattern
matches may be what they miss: its label counts as "other" but for ``MISSED``, which is shared by the kinds; and if it is
like a matched node, it says nothing and is left out.  And what a pattern matches is told by its shape, and needs no
links; so each node also counts with its shape hidden, with its shape and neighbours hidden, and with its shape and like
nodes hidden.  That is where the weights of each kind of link come from, and those of shapes that were never seen.

Loopy sum-product messages run over neighbour and skip links, also in documents without base spans; a node whose belief
in one kind reaches ``BELIEF`` becomes a further span of it.  So a number that is written once as a phone number is one
wherever it recurs.

Every text is searched whole, in one pass without a shuffle.  Nodes, links and messages are flat arrays, some 150 bytes
a node; nodes without links are judged by their shapes alone.  Offsets are code points, ends exclusive.  A null or empty
text has no spans; further columns are kept, one named ``pii`` is replaced; repeated rows give equal results, an empty
table an empty one.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.arrow import extended, pieces, with_fields
from lexweave.llm.common import Held, table
from lexweave.llm.secret_scan import count_of, joined, replaced

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
BELIEF, ROUNDS, DAMPING = 0.9, 8, 0.3
#: The share of unmatched nodes that are taken to be what patterns miss, and what draws weights to 0.
MISSED, DECAY = 0.2, 1.0
#: Links whose messages are worked out at a time.
BLOCK = 100_000
#: Digits by which similar numbers are linked.
TAIL = 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# After a match, and after a failed start, no match can start inside the same run of digits: the lookbehind only saves time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
# What parts words, and what is no part of a node at its ends.
_PARTING = ",;|<>\"'`[]{}"
_PARTS = re.compile(rf"[\s{re.escape(_PARTING)}]")
_EDGE = ".:!?()#*$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Nodes:
    """Parts of words that hold a digit or an @, of one text."""

    def __init__(self) -> None:
        self.starts, self.ends = array("q"), array("q")
        #: Number of each node's shape in ``names``, and of its base kind, 0 for none.
        self.shapes, self.seen = array("i"), array("b")
        self.names: dict[str, int] = {}
        #: Nodes, in order of their next like ones, and those.
        self.far, self.far_next = array("q"), array("q")

    def near(self, text: str) -> array:
        """Nodes whose next one follows after one blank."""
        return array("q", (i for i in range(len(self.starts) - 1) if self.starts[i + 1] - self.ends[i] <= 3 and text[self.ends[i] : self.starts[i + 1]].strip("()") == " "))


def _shape(word: str, digits: str) -> str:
    n = len(digits)
    size = "0" if not n else "1-3" if n < 4 else "4-6" if n < 7 else "7-8" if n < 9 else "9-11" if n < 12 else "12-19" if n < 20 else "20+"
    marks = [c for c in "@+(.-:/=" if c in word]
    return f"{size}{''.join(marks)}{'a' if any(c.isalpha() for c in word) else ''}{'L' if 12 <= n <= 19 and luhn(digits) else ''}"


def _key(word: str, digits: str) -> str | None:
    if "@" in word or (any(c.isalpha() for c in word) and len(word) >= 5):
        return f"n{word.partition('@')[0].lower()}"
    return f"d{digits[-TAIL:]}" if len(digits) >= TAIL else None


def _words(text: str) -> Iterator[tuple[int, int]]:
    """Parts of words that hold a digit or an @, without marks at their ends."""
    at = 0
    while m := _NODE.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in _PARTING and not text[start - 1].isspace():
            start -= 1
        end = at = e.start() if (e := _PARTS.search(text, m.end())) else len(text)
        word = text[start:end]
        start += len(word) - len(word.lstrip(_EDGE))
        if word := word.strip(_EDGE):
            yield start, start + len(word)


def _met(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Parts of words, and the base span that covers most of each (-1 for none)."""
    b = 0
    for start, last in _words(text):
        while b < len(base) and base[b][2] <= start:
            b += 1
        most, span, j = 0, -1, b
        while j < len(base) and base[j][1] < last:
            covered = min(last, base[j][2]) - max(start, base[j][1])
            if covered > most:
                most, span = covered, j
            j += 1
        yield start, last, span


def nodes_of(text: str, base: list[tuple[str, int, int]]) -> Nodes:
    out, latest = Nodes(), {}
    for (span, _), same in itertools.groupby(enumerate(_met(text, base)), key=lambda x: (x[1][2], x[0] if x[1][2] < 0 else -1)):
        start, last = None, 0
        for _, (a, last, _) in same:
            start = a if start is None else start
        word, i = text[start:last], len(out.starts)
        digits = _NOT_DIGIT.sub("", word)
        out.starts.append(start)
        out.ends.append(last)
        out.shapes.append(out.names.setdefault(_shape(word, digits), len(out.names)))
        out.seen.append(KINDS.index(base[span][0]) + 1 if span >= 0 else 0)
        if (key := _key(word, digits)) is not None:
            if key in latest:
                out.far.append(latest[key])
                out.far_next.append(i)
            latest[key] = i
    return out


def combinations(text: str, base: list[tuple[str, int, int]]) -> Counter:
    """How often each (shape, label, labels of the neighbours before, after, and of the like nodes before, after) occurs; -1 for none."""
    nodes = nodes_of(text, base)
    n = len(nodes.starts)
    label, links = list(nodes.seen), list(zip(nodes.far, nodes.far_next))
    matched = [y > 0 for y in label]
    for i, j in links:
        matched[j] = matched[j] or matched[i]
    for i, j in reversed(links):
        matched[i] = matched[i] or matched[j]
    # An unmatched node like a matched one may be what the patterns miss.
    label = [-1 if m and not y else y for y, m in zip(label, matched)]
    around = [[-1] * n for _ in range(4)]
    for i in nodes.near(text):
        around[1][i], around[0][i + 1] = label[i + 1], label[i]
    for i, j in links:
        around[3][i], around[2][j] = label[j], label[i]
    names = list(nodes.names)
    return Counter((names[s], y, *c) for s, y, c in zip(nodes.shapes, label, zip(*around)) if y >= 0)


@dataclass
class Field:
    """Weights: of any shape's labels, of a shape's besides, of neighbours' labels, of like nodes' labels (both symmetric)."""

    any_shape: np.ndarray
    shapes: dict[str, np.ndarray]
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def fitted(counts: Counter, steps: int = 300) -> Field:
        """The weights of the greatest pseudo-likelihood, from counts of ``combinations``."""
        k = len(LABELS)
        names = sorted({c[0] for c in counts})
        if not names:
            return Field(np.zeros(k), {}, np.zeros((k, k)), np.zeros((k, k)))
        number = {s: i for i, s in enumerate(names)}
        rows = sorted(counts.items())
        # A node counts with all it has, and without (shape 0 has weights held at 0): its shape, that and near ones, that and far ones.
        shape = np.array([number[c[0]] + 1 for c, _ in rows] + [0] * (3 * len(rows)))
        label = np.array([c[1] for c, _ in rows] * 4)
        around = np.array([c[2:] for c, _ in rows] * 2 + [(-1, -1, *c[4:]) for c, _ in rows] + [(*c[2:4], -1, -1) for c, _ in rows])
        weight = np.array([n for _, n in rows] * 4, float)
        missed = MISSED / (k - 1)
        aim = np.where((label == 0)[:, None], np.array([1 - MISSED] + [missed] * (k - 1)), np.eye(k)[label])
        given = [np.eye(k + 1)[around[:, a]][:, :k] + np.eye(k + 1)[around[:, a + 1]][:, :k] for a in (0, 2)]

        def unpacked(x: np.ndarray) -> tuple[np.ndarray, ...]:
            return x[:k], x[k : k + k * (len(names) + 1)].reshape(-1, k), x[-2 * k * k : -k * k].reshape(k, k), x[-k * k :].reshape(k, k)

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            any_shape, own, near, far = unpacked(x)
            z = any_shape + own[shape] + given[0] @ (near + near.T) + given[1] @ (far + far.T)
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            d = weight[:, None] * (np.exp(z) - aim)
            g_own = np.zeros_like(own)
            np.add.at(g_own, shape, d)
            g_own[0] = 0
            pair = [given[a].T @ d for a in (0, 1)]
            g = np.concatenate([d.sum(0), g_own.ravel(), *[(m + m.T).ravel() for m in pair]]) + DECAY * x
            return float(-(weight[:, None] * aim * z).sum() + 0.5 * DECAY * x @ x), g

        x = _minimised(loss, np.zeros(k + k * (len(names) + 1) + 2 * k * k), steps)
        any_shape, own, near, far = unpacked(x)
        return Field(any_shape, {s: own[i + 1] for s, i in number.items()}, near + near.T, far + far.T)

    def beliefs(self, text: str, nodes: Nodes) -> np.ndarray:
        """Each node's distribution over the labels, by loopy message passing."""
        table = np.array([self.any_shape + self.shapes.get(s, 0.0) for s in nodes.names], np.float32)
        own, seen = table[np.frombuffer(nodes.shapes, np.int32)], np.frombuffer(nodes.seen, np.int8)
        own[seen > 0] = -20
        own[seen > 0, seen[seen > 0]] = 0
        near, far, far_next = (np.frombuffer(x, np.int64) for x in (nodes.near(text), nodes.far, nodes.far_next))
        first, second = np.concatenate((near, far)), np.concatenate((near + 1, far_next))
        # The weights are symmetric, so both ways of a link have the same table.
        tables = np.concatenate((self.near[None], self.far[None])).astype(np.float32)
        kind = np.concatenate((np.zeros(len(near), np.int8), np.ones(len(far), np.int8)))
        there, back = (np.zeros((len(first), len(LABELS)), np.float32) for _ in range(2))

        def total() -> np.ndarray:
            t = own.copy()
            for label in range(len(LABELS)):
                t[:, label] += np.bincount(second, there[:, label], len(own)) + np.bincount(first, back[:, label], len(own))
            return t

        def sent(now: np.ndarray, kinds: np.ndarray) -> np.ndarray:
            new = np.logaddexp.reduce(now[:, :, None] + tables[kinds], axis=1)
            return new - np.logaddexp.reduce(new, axis=1, keepdims=True)

        for _ in range(ROUNDS if len(first) else 0):
            t = total()
            for a in range(0, len(first), BLOCK):
                part = slice(a, a + BLOCK)
                ahead = sent(t[first[part]] - back[part], kind[part])
                behind = sent(t[second[part]] - there[part], kind[part])
                there[part] = DAMPING * there[part] + (1 - DAMPING) * ahead
                back[part] = DAMPING * back[part] + (1 - DAMPING) * behind
        t = total()
        return np.exp(t - np.logaddexp.reduce(t, axis=1, keepdims=True))


def _minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """The place of the least of a convex function, by limited-memory quasi-Newton steps that are halved till they pay."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max() <= 1e-6 * max(1.0, abs(f)):
            break
        way, alphas = -g, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ way))
            way = way - alphas[-1] * y
        if past:
            way = way * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), alpha in zip(past, reversed(alphas)):
            way = way + s * (alpha - r * (y @ way))
        slope, size = g @ way, 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        while True:
            to = x + size * way
            f_to, g_to = loss(to)
            if f_to <= f + 1e-4 * size * slope or size < 1e-12:
                break
            size /= 2
        if not f_to < f:
            break
        if (to - x) @ (g_to - g) > 1e-12:
            past = [*past, (to - x, g_to - g, 1.0 / ((to - x) @ (g_to - g)))][-memory:]
        x, f, g = to, f_to, g_to
    return x


def further_spans(text: str | None, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans that the random field adds to the base spans of a text; neighbours of one kind are one span."""
    if not text or not _NODE.search(text):
        return []
    nodes = nodes_of(text, base)
    if not len(nodes.starts) or all(nodes.seen):
        return []
    belief = field.beliefs(text, nodes)
    best = belief.argmax(1)
    chosen = np.flatnonzero((best > 0) & (np.frombuffer(nodes.seen, np.int8) == 0) & (belief.max(1) >= BELIEF))
    out: list[tuple[int, int, int, int]] = []
    joins = set(nodes.near(text)) if len(chosen) else set()
    for i in chosen.tolist():
        if out and out[-1][0] == best[i] and out[-1][3] == i - 1 and i - 1 in joins:
            out[-1] = (out[-1][0], out[-1][1], nodes.ends[i], i)
        else:
            out.append((int(best[i]), nodes.starts[i], nodes.ends[i], i))
    return [(LABELS[k], a, b) for k, a, b, _ in out]


def _counts(docs: DataFrame, text: str) -> Counter:
    """``combinations`` of all texts.  There are as many rows as combinations, whatever the corpus: labels are 5, and shapes a few hundred."""
    names = ("shape", "label", "before", "after", "far_before", "far_after")
    schema = pa.schema([(x, pa.string() if x == "shape" else pa.int32()) for x in names] + [("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            c: Counter = Counter()
            for t in batch.column(text).to_pylist():
                if t and _NODE.search(t):
                    c.update(combinations(t, base_spans(t)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, k)) | {"n": n} for k, n in c.items()], schema=schema)

    kinds = ", ".join(f"{x} {'string' if x == 'shape' else 'int'}" for x in names)
    rows = docs.select(text).mapInArrow(count, f"{kinds}, n bigint").groupBy(*names).agg(F.sum("n").alias("n"))
    return Counter({tuple(r[x] for x in names): r["n"] for r in rows.collect()})


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", redacted: str | None = None) -> DataFrame:
    """``docs`` with ``pii``, an array of (kind, start, end, base); redacted: a column for the text with ``[kind]`` instead."""
    field = Field.fitted(_counts(docs, text))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    fields = [T.StructField("pii", T.ArrayType(span))] + ([T.StructField(redacted, T.StringType())] if redacted else [])
    held = Held(docs, None, text)
    schema = with_fields(held.rows.schema, fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            found, clean = [], []
            for t in batch.column("t").to_pylist():
                base = base_spans(t) if t else []
                spans = [(*s, True) for s in base] + [(*s, False) for s in further_spans(t, base, field)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                found.append([{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in spans])
                if redacted:
                    clean.append(replaced(t, [s[:3] for s in spans]))
            yield extended(batch, schema, {"pii": found} | ({redacted: clean} if redacted else {}))

    return held.back(held.rows.mapInArrow(scan, schema), [f.name for f in fields])


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    return found.select(
        "doc_id", *[count_of(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("bigint").alias("n_pii"),
    )
