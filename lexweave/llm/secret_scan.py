"""Secret scan: an Aho-Corasick prefilter for keywords, anchored expressions at its hits, then checksums.

One automaton of all keywords runs over each text.  Expressions are matched only where it hits, at the hit itself.
Plain hex digits have no keyword, so their runs are measured on the text's bytes instead.  Tokens that carry a checksum
(the last six characters are the CRC-32 of the rest, in base 62) are reported only if it is right.

Kinds, in this order: assign, access, hex (the base kinds, reported by pattern alone), github, npm (by checksum).
Offsets are code points, ends exclusive.

Each text is looked at on its own, in one pass without a shuffle.  A null or empty text has no secrets; other columns
are kept, and one named ``secrets`` (or as the redacted text) is replaced; repeated rows give equal results, an empty
table an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.arrow import extended, pieces, with_fields
from lexweave.llm.common import Held, table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB, _NPM = re.compile(r"(gh[pousr])_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), re.compile(r"(npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Small-letter keyword: the kind whose expression it anchors.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM}
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
HEX_LENGTH, ACCESS_LENGTH, VALUE_LENGTH = 24, 20, 6


def checksum62(body: str) -> str:
    """CRC-32 as six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS62[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= VALUE_LENGTH
    if kind == "access":
        return len(m[0]) >= ACCESS_LENGTH
    return checksum62(m[2]) == m[3]


def _hex_runs(text: str) -> list[tuple[int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    on = _HEX[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= HEX_LENGTH
    starts, ends = starts[long], ends[long]
    if len(raw) != len(text) and len(starts):
        # Code points before a byte: those whose first byte is before it.
        before = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        starts, ends = before[starts] - 1, before[ends - 1]
    return list(zip(starts.tolist(), ends.tolist()))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def secrets_in(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    # Small letters of as many characters: the dotted capital I is the only one that would become two.
    small = text.replace("İ", "I").lower()
    hits: dict[str, list[int]] = {}
    for last, (kind, n) in automaton.iter(small):
        hits.setdefault(kind, []).append(last + 1 - n)
    out = [("hex", a, b) for a, b in _hex_runs(text)]
    for kind, at in hits.items():
        done = 0
        for start in sorted(at):
            # A match uses its characters up even where it isn't valid: matches of a kind don't overlap.
            if start >= done and (m := _PATTERNS[kind].match(text, start)):
                done = m.end()
                if _valid(kind, m):
                    out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text", redacted: str | None = None) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end); redacted: a column for the text with ``[kind]`` instead."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("secrets", T.ArrayType(span))] + ([T.StructField(redacted, T.StringType())] if redacted else [])
    held = Held(docs, None, text)
    schema = with_fields(held.rows.schema, fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in pieces(batches, "t"):
            found, clean = [], []
            for t in batch.column("t").to_pylist():
                spans = secrets_in(t, automaton) if t else []
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                if redacted:
                    clean.append(replaced(t, spans))
            yield extended(batch, schema, {"secrets": found} | ({redacted: clean} if redacted else {}))

    return held.back(held.rows.mapInArrow(scan, schema), [f.name for f in fields])


def replaced(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind in brackets."""
    if not text or not spans:
        return text
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op3_keyword_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count_of(base, k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
