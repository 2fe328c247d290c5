"""Candidate entities of examples: by identifier (anchored) and by surface n-grams.

Knowledge base rows: qid, target_lang, label_en, aliases_en, target_label, target_aliases, entity_type, description,
language_available, popularity, surfaces (normalised).  Examples: example_id, source, target_lang, gold_qid.

A surface's best ``per_surface_k`` entities don't depend on the example, so they are ranked once on the index, and with
the anchored entities they make one table of lookups by (kind, key, language).  Examples ask for their gold entity and
for those of their n-grams that may be surfaces.  These are found where a text's words are, before any becomes a row, so texts
are not shuffled and hardly any n-grams are: an n-gram must be in a Bloom filter of all surfaces, which has ``BITS`` bits
a surface however many there are.  The filter is split by hash into tables of ``TABLE_BITS`` at most.  Each is broadcast
and held against the n-grams of its range in a branch of its own, and what the branches find is put together.  Words are
hashed by column expressions; their n-grams' hashes are products of whole Arrow batches, which took a third of the time
that expressions over arrays took.

What is looked up are keys, ranks and the number of the knowledge base's row; its fields are joined to the ranked
candidates that are left in the end.  Several modes share one lookup: its hits are ranked once for each set of stages
that a mode looks at.  Examples are dealt out by id once, which serves all windows.

Where surfaces yield ``SMALL`` entities at most in all, however large the knowledge base, no hit becomes a row before it is
ranked: the ranked index is broadcast, and each example gets the numbers of its hits, in their order, in the pass that
hashes its n-grams (equal hashes are held against the words).  Of these only the numbers that can become candidates are
kept.  Examples then meet their gold entities by identifier and are
dealt out by id, as one row each; candidates come of that row with the broadcast entities' fields.  Texts and
fields of gold entities are dealt out only if they are asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexweave.functions import text as tx
from lexweave.sources import shared

MODES = ("anchored", "surface", "retrieve", "rerank")
KB_FIELDS = ("target_label", "target_aliases", "label_en", "aliases_en", "entity_type", "description", "popularity")
#: Bits a surface in the filter that n-grams are held against, and bits of one of its tables, at most 2^28.
BITS, TABLE_BITS = 16, 1 << 27
#: Rows of a ranked index that are broadcast at most.
SMALL = 1 << 16
_ANCHORED, _SURFACE = 0, 1
_LOW = 0xFFFFFFFF
#: The sets of candidates that modes choose from, by the stages they have; two modes choose from all.
_SETS = {"anchored": "anchored", "surface": "surface", "retrieve": "all", "rerank": "all"}


@dataclass(frozen=True)
class Carry:
    """What candidates keep of their examples and spans, made before these meet.

    examples: adds columns to examples (source, gold_qid, and _anchor, their first anchored candidate); span: what is made of the
    text of a surface, once a row of the index.
    """

    examples: Callable[[DataFrame], DataFrame]
    span: Callable[[Column], Column]


def usable() -> Column:
    """An entity that can be used in its language: available there, with a label."""
    return F.coalesce(F.col("language_available"), F.lit(False)) & (tx.safe("target_label") != "")


def _kb_row() -> Column:
    """Number of a row of the knowledge base: equal for rows of equal fields, their surfaces aside."""
    return F.xxhash64("qid", "target_lang", "language_available", *KB_FIELDS)


def surface_index(kb: DataFrame) -> DataFrame:
    """(surface, qid, target_lang, popularity, usable, kb_row): one row for each entity and surface, the most popular of equal ones.

    Rows are dealt out by surface, which serves all windows over the index.
    """
    some = kb.select("qid", "target_lang", "target_label", "popularity", usable().alias("usable"), _kb_row().alias("kb_row"), F.explode(F.array_distinct("surfaces")).alias("surface"))
    nth = F.row_number().over(Window.partitionBy("surface", "qid", "target_lang").orderBy(F.desc("popularity"), "target_label", "kb_row"))
    return some.where("surface <> ''").repartition("surface").withColumn("_nth", nth).where("_nth = 1").drop("_nth", "target_label")


def ambiguity(index: DataFrame) -> DataFrame:
    """(surface, ambiguity_count): entities that share a surface, usable or not."""
    return index.groupBy("surface").agg(F.countDistinct("qid").alias("ambiguity_count"))


def ranked_index(index: DataFrame, per_surface_k: int = 5) -> DataFrame:
    """The usable entities that a surface can yield: its ``per_surface_k`` most popular ones, with their ranks and its ambiguity."""
    rank = F.row_number().over(Window.partitionBy("surface", "target_lang").orderBy(F.desc("usable"), F.desc("popularity"), "qid"))
    entity = F.dense_rank().over(Window.partitionBy("surface").orderBy("qid"))
    counted = index.withColumn("_entity", entity).withColumn("ambiguity_count", F.max("_entity").over(Window.partitionBy("surface")).cast("bigint"))
    return counted.withColumn("in_span_rank", rank).where(F.col("usable") & (F.col("in_span_rank") <= per_surface_k)).drop("_entity")


def anchored_index(kb: DataFrame) -> DataFrame:
    """(qid, target_lang, kb_row): the most popular usable row of each entity."""
    rank = F.row_number().over(Window.partitionBy("qid", "target_lang").orderBy(F.desc("popularity"), "target_label"))
    return kb.where(usable()).select("qid", "target_lang", "popularity", "target_label", _kb_row().alias("kb_row")).withColumn("_nth", rank).where("_nth = 1").select("qid", "target_lang", "kb_row")


def anchor_rows(kb: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(qid, target_lang, and fields): the most popular usable row of each entity."""
    nth = F.row_number().over(Window.partitionBy("qid", "target_lang").orderBy(F.desc("popularity"), "target_label"))
    return kb.where(usable()).select("qid", "target_lang", *fields, nth.alias("_nth")).where("_nth = 1").drop("_nth")


def asking(examples: DataFrame) -> DataFrame:
    """Examples that can have candidates: those with a source and a language."""
    return examples.where((tx.safe("source") != "") & (tx.safe("target_lang") != ""))


_PRIME, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams from each place on, in a run of words' hashes (64 bits, without a sign)."""
    last = max(0, len(h) - n + 1)
    g = h[:last].copy()
    for j in range(1, n):
        g = g * _PRIME + h[j : j + last]
    g ^= g >> np.uint64(29)
    g *= _OTHER
    return g ^ (g >> np.uint64(32))


def _places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's two places in a table."""
    return g & np.uint64(bits - 1), (g >> np.uint64(36)) & np.uint64(bits - 1)


def _piece(g: np.ndarray, pieces: int) -> np.ndarray:
    """Which of the filter's tables a hash belongs to."""
    return (g * _PRIME >> np.uint64(40)) % np.uint64(pieces)


def _held(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An array column's numbers, as such without a sign, and where its rows end."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(np.diff(column.offsets.to_numpy()))


def _filter_size(n_surfaces: int) -> tuple[int, int]:
    """Tables of the filter, and bits of each, a power of two."""
    pieces = max(1, -(-BITS * n_surfaces // TABLE_BITS))
    return pieces, min(TABLE_BITS, max(1 << 12, 1 << max(0, -(-BITS * n_surfaces // pieces) - 1).bit_length()))


def _numbers(surfaces: DataFrame, pieces: int, bits: int, min_n: int, max_n: int) -> DataFrame:
    """(piece, id, bits): the filter's numbers of 64 bits that aren't 0."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = _flat(batch.column("h"))
            sizes = np.diff(ends, prepend=0)
            for n in range(min_n, max_n + 1):
                g = gram_hashes(h, n)[(ends - sizes)[sizes == n]]
                if not len(g):
                    continue
                at = np.concatenate(_places(g, bits))
                values = [np.tile(_piece(g, pieces), 2), at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))]
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in values], names=["piece", "id", "bits"])

    words = surfaces.select(tx.tokens("surface").alias("w")).where(F.size("w").between(min_n, max_n)).select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    return words.mapInArrow(placed, "piece bigint, id bigint, bits bigint").groupBy("piece", "id").agg(F.bit_or("bits").alias("bits"))


def _table(numbers: DataFrame, piece: int, bits: int) -> np.ndarray:
    """One of the filter's tables, of a bounded size, as the driver broadcasts it."""
    own = numbers.where(F.col("piece") == piece).select("id", "bits").toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[own.column("id").to_numpy()] = own.column("bits").to_numpy().view(np.uint64)
    return out


def example_spans(examples: DataFrame, min_n: int = 1, max_n: int = 5, min_chars: int = 2) -> DataFrame:
    """A row for each valid distinct n-gram of each source."""
    return asking(examples).select("example_id", "target_lang", F.explode(tx.candidate_spans("source", min_n, max_n, min_chars)).alias("surface"))


def _found_spans(rows: DataFrame, table: Broadcast, bits: int, piece: int, pieces: int, min_n: int, max_n: int) -> DataFrame:
    """Rows (example_id, target_lang, words, h) with ``spans``, the (start, n) of their n-grams that a table of the filter holds; those without any are left out."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            h, ends = _flat(batch.column("h"))
            # The place behind the row that a word stands in.
            end = np.repeat(ends, np.diff(ends, prepend=0))
            starts, sizes = [], []
            for n in range(min_n, max_n + 1):
                g = gram_hashes(h, n)
                one, other = _places(g, bits)
                met = _held(own, one)
                met &= np.arange(len(g)) + n <= end[: len(g)]
                at = np.flatnonzero(met)
                at = at[_held(own, other[at])]
                if pieces > 1:
                    at = at[_piece(g[at], pieces) == piece]
                starts.append(at)
                sizes.append(np.full(len(at), n))
            start, size = np.concatenate(starts), np.concatenate(sizes)
            row = np.searchsorted(ends, start, "right")
            order = np.argsort(row, kind="stable")
            start, size, row = start[order], size[order], row[order]
            begins = np.concatenate(([0], ends))[row]
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array((start - begins).astype(np.int32)), pa.array(size.astype(np.int32))], names=["start", "n"]))
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("example_id", "target_lang", "words")], spans], names=["example_id", "target_lang", "words", "spans"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return rows.mapInArrow(found, f"example_id {rows.schema['example_id'].dataType.simpleString()}, target_lang string, words array<string>, spans array<struct<start: int, n: int>>")


def _asked(examples: DataFrame, surfaces: DataFrame | None, n_surfaces: int, anchored: bool, min_n: int, max_n: int, min_chars: int) -> DataFrame:
    """(example_id, target_lang, stage, key): what examples look up."""
    some, parts = asking(examples), []

    def rows(frame: DataFrame, stage: int, keys: Column) -> DataFrame:
        return frame.select("example_id", "target_lang", F.lit(stage).alias("stage"), F.explode(keys).alias("key"))

    if anchored:
        parts.append(rows(some, _ANCHORED, F.filter(F.array(tx.or_null("gold_qid")), lambda q: q.isNotNull())))
    if surfaces is not None:
        low, high = max(1, min_n), max(1, min_n, max_n)
        pieces, bits = _filter_size(n_surfaces)
        numbers = _numbers(surfaces, pieces, bits, low, high)
        if pieces > 1:
            # Written by piece once, so that each table is made of its own numbers alone.
            held = shared.folder(examples.sparkSession)
            numbers.write.partitionBy("piece").parquet(held)
            numbers = examples.sparkSession.read.schema("id bigint, bits bigint, piece bigint").parquet(held)
        read = some.select("example_id", "target_lang", tx.tokens(tx.normalize_surface("source")).alias("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
        for i in range(pieces):
            found = _found_spans(read, examples.sparkSession.sparkContext.broadcast(_table(numbers, i, bits)), bits, i, pieces, low, high)
            spans = F.array_distinct(F.transform("spans", lambda x: F.array_join(F.slice("words", x["start"] + 1, x["n"]), " ")))
            keys = rows(found, _SURFACE, spans)
            parts.append(keys.where((F.char_length("key") >= min_chars) & F.col("key").rlike(r"\p{L}")))
        if pieces > 1:
            shared.delete(examples.sparkSession, held)
    return functools.reduce(DataFrame.unionByName, parts)


def _small_index(ranked: DataFrame, min_n: int, max_n: int, min_chars: int) -> pa.Table | None:
    """A ranked index's rows that n-grams can ask for, in the order of candidates, with their words' hashes h; None if there are more than ``SMALL``."""
    key = F.col("surface").alias("key")
    valid = (F.char_length("surface") >= min_chars) & F.col("surface").rlike(r"\p{L}") & tx.token_count("surface").between(min_n, max_n)
    words = tx.tokens("surface")
    rows = ranked.where(valid).select(key, "target_lang", "qid", "kb_row", "in_span_rank", "ambiguity_count", words.alias("w"), F.transform(words, lambda x: F.xxhash64(x)).alias("h"), F.size(words).alias("n_tokens"), F.char_length("surface").alias("n_chars"))
    found = rows.limit(SMALL + 1).toArrow()
    return None if found.num_rows > SMALL else found.sort_by([("n_tokens", "descending"), ("n_chars", "descending"), ("key", "ascending"), ("in_span_rank", "ascending")])


def _with_hits(rows: DataFrame, index: pa.Table, min_n: int, max_n: int, longest: int) -> DataFrame:
    """Rows (target_lang, gold, words, h, ...) with ``hits``, the index's rows that they ask for, as l * 2^32 + q: numbers of row and qid, the first row of each qid, in order, ``longest`` at most; g is gold's number."""
    keys, langs, qids = [index.column(c).combine_chunks().dictionary_encode() for c in ("key", "target_lang", "qid")]
    first = np.unique(keys.indices.to_numpy(zero_copy_only=False), return_index=True)[1]
    n_langs, lang = max(1, len(langs.dictionary)), langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    entry = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_langs + lang
    some = np.flatnonzero(lang >= 0)
    by_entry = some[np.argsort(entry[some], kind="stable")]
    begins = np.searchsorted(entry[by_entry], np.arange(len(first) * n_langs + 1))
    q_of = qids.indices.fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
    words = index.column("w").take(pa.array(first)).combine_chunks()
    sizes, flat = np.array([len(w) for w in words], np.int64), words.flatten()
    places = np.cumsum(sizes) - sizes
    tables = {}
    for n in np.unique(sizes[(sizes >= min_n) & (sizes <= max_n)]).tolist():
        own = np.flatnonzero(sizes == n)
        hashes = index.column("h").take(pa.array(first[own])).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n)
        g = np.array([gram_hashes(h, n)[0] for h in hashes], np.uint64)
        order = np.argsort(g, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[g >> np.uint64(44)] = True
        tables[n] = (g[order], own[order], seen)
    known = rows.sparkSession.sparkContext.broadcast((tables, by_entry, begins, q_of, langs.dictionary, qids.dictionary, flat, places, n_langs))
    passed = [f.name for f in rows.schema if f.name not in ("words", "h")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, by_entry, begins, q_of, langs, qids, flat, places, n_langs = known.value
        for batch in batches:
            h, ends = _flat(batch.column("h"))
            end = np.repeat(ends, np.diff(ends, prepend=0))
            own = batch.column("words").flatten()
            at_of, key_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, (g_of, numbers, seen) in tables.items():
                g = gram_hashes(h, n)
                at = np.flatnonzero(seen[g >> np.uint64(44)] & (np.arange(len(g)) + n <= end[: len(g)]))
                low = np.searchsorted(g_of, g[at])
                # Keys of equal hashes lie side by side.
                while len(at):
                    fits = low < len(g_of)
                    at, low = at[fits], low[fits]
                    fits = g_of[low] == g[at]
                    at, low = at[fits], low[fits]
                    same = np.ones(len(at), bool)
                    for j in range(n):
                        same &= pc.equal(own.take(pa.array(at + j)), flat.take(pa.array(places[numbers[low]] + j))).to_numpy(zero_copy_only=False)
                    at_of.append(at[same])
                    key_of.append(numbers[low][same])
                    low = low + 1
            row, key = np.searchsorted(ends, np.concatenate(at_of), "right"), np.concatenate(key_of)
            lang = pc.index_in(batch.column("target_lang"), value_set=langs).fill_null(-1).to_numpy(zero_copy_only=False)[row]
            row, entry = row[lang >= 0], (key * n_langs + lang)[lang >= 0]
            many = begins[entry + 1] - begins[entry]
            row = np.repeat(row, many)
            l = by_entry[np.repeat(begins[entry], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.lexsort((l, q_of[l], row))
            row, l = row[order], l[order]
            q = q_of[l]
            fresh = np.ones(len(l), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (q[1:] != q[:-1])
            row, l = row[fresh], l[fresh]
            order = np.lexsort((l, row))
            row, l = row[order], l[order]
            some = np.arange(len(row)) - np.searchsorted(row, row) < longest
            row, l = row[some], l[some]
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
            hits = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((l.astype(np.int64) << 32) | (q_of[l] & _LOW)))
            gold = batch.column("gold")
            number = pc.if_else(pc.is_valid(gold), pc.index_in(gold, value_set=qids), pa.scalar(None, pa.int32())).fill_null(-1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], hits, number], names=[*passed, "hits", "g"])

    shape = T.StructType([rows.schema[c] for c in passed]).add("hits", T.ArrayType(T.LongType())).add("g", T.IntegerType())
    return rows.mapInArrow(found, shape)


def _candidates_of_rows(examples: DataFrame, kb: DataFrame, modes: Sequence[str], index: pa.Table | None, top_k: int, min_n: int, max_n: int, fields: Sequence[str], carry: Carry | None) -> DataFrame:
    """``candidates_of_modes`` by a small index, or none for anchored candidates alone."""
    spark, anchored = examples.sparkSession, any(m != "surface" for m in modes)
    told = ["source", "gold_qid"] if carry is not None else []
    rows = asking(examples).select("example_id", "target_lang", *told, (tx.or_null("gold_qid") if anchored else F.lit(None).cast("string")).alias("gold"), *([tx.tokens(tx.normalize_surface("source")).alias("words")] if index is not None else []))
    if index is not None:
        # Candidates are as many as the first hits, however many of these are gold: each such gives an anchored one.
        longest = max(1 if m == "retrieve" else top_k for m in modes if m != "anchored")
        rows = _with_hits(rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))), index, min_n, max_n, longest)
    else:
        rows = rows.withColumn("hits", F.array().cast("array<bigint>")).withColumn("g", F.lit(-1))
    if anchored:
        best = anchor_rows(kb, fields).select(F.col("qid").alias("gold"), "target_lang", F.struct("qid", *fields).alias("anchor"))
        rows = rows.join(best, ["gold", "target_lang"], "left" if index is not None else "inner")
    else:
        nothing = F.struct(F.lit(None).cast("string").alias("qid"), *[F.lit(None).cast(kb.schema[c].dataType).alias(c) for c in fields])
        rows = rows.withColumn("anchor", F.when(F.lit(False), nothing))
    # Rows of one id make one example: their hits are put together, of one qid the first.
    whole = rows.where((F.size("hits") > 0) | F.col("anchor").isNotNull()).groupBy("example_id").agg(F.collect_list(F.struct("hits", "anchor", "g", *told)).alias("r"))
    alone, one = F.size("r") == 1, F.get("r", 0)
    q = lambda x: x.bitwiseAND(F.lit(_LOW))
    l = lambda x: F.shiftright(x, 32).cast("int")

    def merged(parts: Column, same: Callable[[Column, Column], Column]) -> Column:
        none = F.filter(parts, lambda x: F.lit(False))
        return F.aggregate(parts, none, lambda kept, x: F.when(F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.concat(kept, F.array(x))))

    hits = F.when(alone, one["hits"]).otherwise(merged(F.array_sort(F.flatten(F.transform("r", lambda x: x["hits"]))), lambda x, y: q(x) == q(y)))
    anchors = F.filter(F.transform("r", lambda x: x["anchor"]), lambda a: a.isNotNull())
    anchors = F.when(alone, anchors).otherwise(merged(anchors, lambda x, y: x["qid"].eqNullSafe(y["qid"])))
    whole = whole.select("example_id", "r", hits.alias("_hits"), anchors.alias("_anchors"))
    first = F.transform("_anchors", lambda _, i: -1 - i.cast("int"))
    golds = F.transform(F.filter("r", lambda x: x["anchor"].isNotNull()), lambda x: x["g"].cast("bigint"))
    others = F.filter("_hits", lambda x: ~F.array_contains(golds, q(x)))
    by_set = {"anchored": first, "surface": F.transform("_hits", l), "all": F.concat(first, F.transform(others, l))}

    def listed(mode: str) -> Column:
        best = F.slice(by_set[_SETS[mode]], 1, 1 if mode == "retrieve" else top_k)
        return tx.let(best, lambda b: F.transform(b, lambda l, i: F.struct(l.alias("l"), F.lit(mode).alias("mode"), (i + 1).cast("int").alias("rank"), F.get(b, 0).alias("first"))))

    chosen = whole.select("example_id", "r", "_anchors", F.concat(*[listed(m) for m in modes]).alias("_chosen")).where(F.size("_chosen") > 0)
    kept = []
    if carry is not None:
        parts = chosen.select("example_id", "_anchors", "_chosen", F.explode("r").alias("_row")).select("example_id", "_anchors", "_chosen", "_row.source", "_row.gold_qid")
        chosen = carry.examples(parts.withColumn("_anchor", F.get("_anchors", 0)))
        kept = [c for c in chosen.columns if c not in ("example_id", "_anchors", "_chosen", "_anchor")]
    rows = chosen.select("example_id", "_anchors", *kept, F.explode("_chosen").alias("_c")).select("example_id", *kept, F.get("_anchors", -1 - F.col("_c.l")).alias("_a"), "_c.l", "_c.mode", "_c.rank", "_c.first")
    if index is None:
        out = {"qid": F.col("_a.qid"), "source_span": F.lit(None).cast("string"), "n_tokens": F.lit(0), "n_chars": F.lit(0), "in_span_rank": F.lit(1), "ambiguity_count": F.lit(1).cast("bigint")} | {c: F.col("_a")[c] for c in fields}
        rows = rows.withColumn("_first_span", F.lit(None).cast("string"))
        if carry is not None:
            nothing = F.when(F.lit(False), carry.span(F.lit("")))
            rows = rows.withColumns({"_own": nothing, "_first_own": nothing})
    else:
        held = spark.createDataFrame(index.append_column("l", pa.array(np.arange(index.num_rows, dtype=np.int32))).drop_columns(["w", "h", "target_lang"]), "key string, qid string, kb_row bigint, in_span_rank int, ambiguity_count bigint, n_tokens int, n_chars int, l int")
        of_index = kb.select(_kb_row().alias("kb_row"), *fields).join(F.broadcast(held), "kb_row").dropDuplicates(["l"]) if fields else held
        if carry is not None:
            held = held.withColumn("_own", carry.span(F.col("key")))
            of_index = of_index.withColumn("_own", carry.span(F.col("key")))
        of_index = of_index.select("l", *(["_own"] if carry is not None else []), F.struct("qid", "key", "n_tokens", "n_chars", "in_span_rank", "ambiguity_count", *fields).alias("_e"))
        rows = rows.join(F.broadcast(of_index), "l", "left")
        rows = rows.join(F.broadcast(held.select(F.col("l").alias("first"), F.col("key").alias("_first_span"), F.col("_own").alias("_first_own"))), "first", "left") if carry is not None else rows
        by_surface = F.col("l") >= 0
        whole_numbers = {"n_tokens": 0, "n_chars": 0, "in_span_rank": 1, "ambiguity_count": 1}
        out = {"qid": F.when(by_surface, F.col("_e.qid")).otherwise(F.col("_a.qid")), "source_span": F.col("_e.key")} | {c: F.coalesce(F.col("_e")[c], F.lit(v)) for c, v in whole_numbers.items()}
        out |= {c: F.when(by_surface, F.col("_e")[c]).otherwise(F.col("_a")[c]) for c in fields}
    stage = F.when(F.col("l") < 0, _ANCHORED).otherwise(_SURFACE)
    source = F.when(F.col("l") < 0, "anchored_qid").otherwise("surface_search")
    order = ["qid", "source_span", "n_tokens", "n_chars", "in_span_rank", "ambiguity_count", *fields]
    own = [out[c].alias(c) for c in order]
    carried = [*kept, F.when(F.col("l") == -1, True).otherwise(False).alias("_is_anchor"), F.when(F.col("first") < 0, True).otherwise(False).alias("_anchor_first"), "_first_span", "_own", "_first_own"] if carry is not None else []
    return rows.select("example_id", "mode", own[0], stage.alias("stage"), source.alias("candidate_source"), *own[1:], "rank", *carried)


def candidates_of_modes(
    examples: DataFrame, kb: DataFrame, modes: Sequence[str], index: DataFrame | None = None, top_k: int = 10, per_surface_k: int = 5, min_n: int = 1, max_n: int = 5, min_chars: int = 2, more: Sequence[str] = (),
    carry: Carry | None = None, fields: Sequence[str] = KB_FIELDS,
) -> DataFrame:
    """Ranked candidates of each example in each mode, as ``candidates`` gives them for one, with the column ``mode``.

    All modes share one lookup and one deal of its hits by example.  fields, more: the columns of the knowledge base that candidates get, and further ones.  carry: what
    candidates are to keep of their examples and spans.  Those of a small index do, and they have _is_anchor, _anchor_first and
    _first_span, by which the first candidate's span is known, and _own and _first_own, what was made of it and of their own.
    """
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}: {mode}")
    tables, by_surface, n_surfaces, small, wanted = [], None, 0, None, [*fields, *more]
    if any(m != "anchored" for m in modes):
        by_surface = surface_index(kb) if index is None else index
        ranked = ranked_index(by_surface, per_surface_k)
        small = _small_index(ranked, max(1, min_n), max(1, min_n, max_n), min_chars)
    if small is not None or by_surface is None:
        return _candidates_of_rows(examples, kb, modes, small, top_k, max(1, min_n), max(1, min_n, max_n), wanted, carry)
    if any(m != "surface" for m in modes):
        found = anchored_index(kb).select("target_lang", "qid", "kb_row", F.lit(_ANCHORED).alias("stage"), F.col("qid").alias("key"), F.lit(1).alias("in_span_rank"), F.lit(1).cast("bigint").alias("ambiguity_count"))
        tables.append(found)
    if by_surface is not None:
        n_surfaces = kb.agg(F.sum(F.greatest(F.size("surfaces"), F.lit(0)))).first()[0] or 0
        tables.append(ranked.select("target_lang", "qid", "kb_row", F.lit(_SURFACE).alias("stage"), F.col("surface").alias("key"), "in_span_rank", "ambiguity_count"))
    lookup = functools.reduce(DataFrame.unionByName, tables)
    surfaces = kb.select(F.explode("surfaces").alias("surface")) if by_surface is not None else None
    hits = _asked(examples, surfaces, n_surfaces, len(tables) == 2 or by_surface is None, min_n, max_n, min_chars).join(lookup, ["stage", "key", "target_lang"])
    span = F.when(F.col("stage") == _SURFACE, F.col("key"))
    rows = hits.select(
        "example_id", "qid", "kb_row", "stage", span.alias("source_span"), F.when(span.isNotNull(), tx.token_count("key")).otherwise(0).alias("n_tokens"),
        F.when(span.isNotNull(), F.char_length("key")).otherwise(0).alias("n_chars"), "in_span_rank", "ambiguity_count",
    )
    sets = sorted({_SETS[m] for m in modes})
    mine = F.array(*[F.when(F.lit(s == "all") | (F.col("stage") == (_ANCHORED if s == "anchored" else _SURFACE)), F.lit(s)) for s in sets])
    order = ["stage", F.desc("n_tokens"), F.desc("n_chars"), "source_span", "in_span_rank"]
    dealt = rows.repartition("example_id")
    # One set has all rows of its lookup.
    dealt = dealt.withColumn("_set", F.lit(sets[0])) if len(sets) == 1 else dealt.withColumn("_set", F.explode(F.array_compact(mine)))
    first = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("example_id", "_set", "qid").orderBy(*order))).where("_nth = 1").drop("_nth")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("example_id", "_set").orderBy(*order)))
    kept = F.array_compact(F.array(*[F.when((F.col("_set") == _SETS[m]) & (F.col("rank") <= (1 if m == "retrieve" else top_k)), F.lit(m)) for m in modes]))
    best = ranked.where(F.col("rank") <= top_k).withColumn("mode", F.explode(kept))
    best = best.join(kb.select(_kb_row().alias("kb_row"), *wanted).dropDuplicates(["kb_row"]), "kb_row") if wanted else best
    source = F.when(F.col("stage") == _ANCHORED, "anchored_qid").otherwise("surface_search")
    return best.select("example_id", "mode", "qid", "stage", source.alias("candidate_source"), "source_span", "n_tokens", "n_chars", "in_span_rank", "ambiguity_count", *wanted, "rank")


def candidates(examples: DataFrame, kb: DataFrame, index: DataFrame | None = None, mode: str = "rerank", top_k: int = 10, per_surface_k: int = 5, min_n: int = 1, max_n: int = 5, min_chars: int = 2, more: Sequence[str] = (), carry: Carry | None = None, fields: Sequence[str] = KB_FIELDS) -> DataFrame:
    """Ranked candidates of each example: anchored ones first, then longer spans before shorter, then by popularity.

    Of rows for one entity the first is kept, and of each example the first ``top_k``; mode "retrieve" keeps one.
    Examples without a source or a language have none.
    """
    return candidates_of_modes(examples, kb, (mode,), index, top_k, per_surface_k, min_n, max_n, min_chars, more, carry, fields).drop("mode")


def first_by_qid(candidates: DataFrame, order: str = "rank") -> DataFrame:
    """Of each example's candidates of one identifier the first; those without an identifier are all kept."""
    named = tx.safe("qid") != ""
    nth = F.row_number().over(Window.partitionBy("example_id", "qid").orderBy(order))
    return candidates.withColumn("_nth", F.when(named, nth).otherwise(1)).where("_nth = 1").drop("_nth")
