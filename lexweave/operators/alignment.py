"""Alignment of labels and aliases with a source text, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import text as tx

# Kinds of matches and their scores.
BOUNDARY, SUBSTRING = ("boundary_exact", 1.0), ("substring", 0.85)
#: Characters that equal others besides their small letters when case is ignored.
_FOLDING = "[ΣσςϐϑϕϖϰϱϵµſİıKÅΩẛιͅᲀ-ᲈ]"


def small(x: Column) -> Column:
    """Small letters of as many characters, so that places in them are places in the text."""
    return F.lower(F.replace(x, F.lit("İ"), F.lit("I")))


def folds_alike(x: Column) -> Column:
    """Whether a text has no letter that equals others besides its small one when case is ignored."""
    return ~x.rlike(_FOLDING)


def raw_match(source: Column, variant: Column, small_source: Column | None = None, plain_source: Column | None = None, small_variant: Column | None = None, plain_variant: Column | None = None) -> Column:
    """The first match of a variant: at word boundaries if there is one, else anywhere; null if there is none.

    Most variants occur nowhere, or the first time at word boundaries, which shows at the place that small letters tell
    and the two characters beside it.  Only for others a regular expression looks further.
    Fields are ordered so that of several matches the greatest is the best: score, length, leftmost start.
    """
    small_source = small(source) if small_source is None else small_source
    plain_source = folds_alike(source) if plain_source is None else plain_source
    small_variant = small(variant) if small_variant is None else small_variant
    plain_variant = folds_alike(variant) if plain_variant is None else plain_variant
    # A variant is quoted piece by piece, as \E would end the quotation.
    quoted = F.concat(F.lit("\\Q"), F.replace(variant, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    bounded = F.concat(F.lit(f"(?isu)^(.*?)(?<!{tx.WORD})("), quoted, F.lit(f")(?!{tx.WORD})"))

    def match(kind: tuple[str, float], start: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind[1]).alias("score"), F.char_length(text).alias("length"), (-start).alias("at"), start.alias("start"),
            text.alias("matched_text"), F.lit(kind[0]).alias("kind"), variant.alias("variant"),
        )

    def judged(at: Column) -> Column:
        length = F.char_length(variant)
        here = F.substring(source, at, length)
        beside = F.concat(F.when(at > 1, F.substring(source, at - 1, F.lit(1))).otherwise(""), F.substring(source, at + length, F.lit(1)))
        free = ~beside.rlike(tx.WORD)
        plain = plain_source & plain_variant
        loose = F.when(at > 0, match(SUBSTRING, at - 1, here))

        def searched(before: Column) -> Column:
            found = F.call_function("regexp_extract", source, bounded, F.lit(2))
            return F.when(found != "", match(BOUNDARY, F.char_length(before), found)).otherwise(loose)

        further = searched(F.call_function("regexp_extract", source, bounded, F.lit(1)))
        return F.when(plain & (at == 0), loose).when(plain & free, match(BOUNDARY, at - 1, here)).otherwise(further)

    return tx.let(F.call_function("locate", small_variant, small_source), judged)


def align_surface(
    source: Column | str, surface: Column | str, small_source: Column | None = None, plain_source: Column | None = None, small_surface: Column | None = None, plain_surface: Column | None = None
) -> Column:
    """The match of a span that is normalised and valid already, such as an n-gram of the source; null for none.

    small_source, plain_source, small_surface, plain_surface: ``small`` and ``folds_alike`` of the stripped source and of the
    span, made before, once an example and once a row of the index.
    """
    return tx.let(raw_match(tx.col(source), tx.col(surface), small_source, plain_source, small_surface, plain_surface), lambda best: _span(tx.col(source), best))


def align(source: Column | str, label: Column | str, aliases: Column | str, min_chars: int = 2) -> Column:
    """The best match of a label and its aliases in a source: by score, then length, then leftmost; null for none."""
    return tx.let(tx.safe(source), lambda text: tx.let(small(text), lambda folded: _best(text, folded, label, aliases, min_chars)))


def variants(label: Column | str, aliases: Column | str, min_chars: int = 2) -> Column:
    """The names of an entity that a source is searched for, which don't depend on the source."""
    names = tx.distinct_by_surface(F.concat(F.array(tx.safe(label)), F.coalesce(tx.col(aliases), F.array().cast("array<string>"))))
    return F.filter(names, lambda v: tx.valid_span(v, min_chars))


def _best(text: Column, folded: Column, label: Column | str, aliases: Column | str, min_chars: int) -> Column:
    return align_names(text, folded, None, variants(label, aliases, min_chars))


def align_names(text: Column, folded: Column, plain: Column | None, names: Column) -> Column:
    """As ``align``, by ``variants`` of an entity, and by ``small`` and ``folds_alike`` of a stripped source."""
    matches = F.filter(F.transform(names, lambda v: raw_match(text, v, folded, plain)), lambda m: m.isNotNull())
    return tx.let(F.array_max(matches), lambda best: _span(text, best))


def _span(text: Column, best: Column) -> Column:
    span = F.struct(best["start"].alias("start"), (best["start"] + best["length"]).alias("end"), best["matched_text"].alias("matched_text"), best["kind"].alias("match_kind"), best["score"].alias("match_score"))
    return F.when(best.isNotNull() & (text != ""), span)


def legacy_span(source: Column | str, label: Column | str, aliases: Column | str) -> Column:
    """The first occurrence, capitals or not, of the longest of a label and its aliases that occurs at all; '' for none.

    Longest by characters; of equally long ones the first by text.
    """
    names = F.array_distinct(F.concat(F.array(tx.safe(label)), F.transform(F.coalesce(tx.col(aliases), F.array().cast("array<string>")), tx.safe)))
    ordered = F.sort_array(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct((-F.char_length(n)).alias("l"), n.alias("n"))))

    def first(text: Column, folded: Column) -> Column:
        at = lambda n: F.call_function("locate", small(n), folded)
        hits = F.filter(ordered, lambda x: at(x["n"]) > 0)
        return tx.let(F.get(hits, 0), lambda x: F.when(x.isNull(), "").otherwise(F.substring(text, at(x["n"]), F.char_length(x["n"]))))

    return tx.let(tx.safe(source), lambda text: tx.let(small(text), lambda folded: first(text, folded)))
