"""Text normalisation, n-grams, spans and matching as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as letters and digits of a word, and as tokens of features.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
FEATURE_TOKEN = "[A-Za-z0-9가-힣_]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row: inside a lambda an expression would be for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(x: Column | str) -> Column:
    """Without white space at either end, Unicode's included; null stays null.

    A column whose text begins and ends with a sign of ASCII, as nearly all do, isn't searched.
    """
    out = F.regexp_replace(col(x), f"^{BLANK}+|{BLANK}+$", "")
    if not isinstance(x, str):
        return out
    first, last = F.left(F.col(x), F.lit(1)), F.right(F.col(x), F.lit(1))
    return F.when(first.between("!", "~") & last.between("!", "~"), F.col(x)).otherwise(out)


def safe(x: Column | str) -> Column:
    """Stripped text, '' for null."""
    return F.coalesce(stripped(x), F.lit(""))


def or_null(x: Column | str) -> Column:
    """Stripped text, null for ''."""
    return F.nullif(stripped(x), F.lit(""))


def first_non_empty(*values: Column | str) -> Column:
    """The first of several texts that isn't empty, stripped; '' if all are."""
    return F.coalesce(*[or_null(v) for v in values], F.lit(""))


def listed(x: Column | str) -> Column:
    """Items of a text that commas part, stripped and not empty."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), ","), safe), lambda s: s != "")


def normalize_surface(x: Column | str) -> Column:
    """Without punctuation, white space collapsed, stripped, small letters."""
    kept = F.regexp_replace(F.coalesce(col(x), F.lit("")), rf"[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\p{{Z}}]", "")
    return F.lower(stripped(F.regexp_replace(kept, f"{BLANK}+", " ")))


def tokens(normalized: Column | str) -> Column:
    """Words of a normalised text; none for ''."""
    return F.filter(F.split(col(normalized), " "), lambda t: t != "")


def first_token(x: Column | str, head: int = 256) -> Column:
    """The first word of a text once normalised, null if it has none; the text's head tells it if a second word follows there."""
    words = tokens(normalize_surface(F.left(col(x), F.lit(head))))
    enough = (F.size(words) > 1) | F.coalesce(F.char_length(col(x)) <= head, F.lit(True))
    return F.when(enough, F.get(words, 0)).otherwise(F.get(tokens(normalize_surface(x)), 0))


def ngrams(words: Column | str, min_n: int = 1, max_n: int = 5) -> Column:
    """Distinct n-grams of an array of words, joined by blanks; min_n is 1 at least and max_n min_n at least."""
    low = max(1, min_n)
    high = max(low, max_n)

    def of(words: Column, n: int) -> Column:
        starts = F.size(words) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(starts, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(starts >= 1, every).otherwise(F.array().cast("array<string>"))

    return let(col(words), lambda w: F.array_distinct(F.flatten(F.array(*[of(w, n) for n in range(low, high + 1)]))))


def token_count(surface: Column | str) -> Column:
    return F.size(tokens(surface))


def valid_span(x: Column | str, min_chars: int = 2) -> Column:
    """Long enough once normalised, not all digits, and with a letter."""
    s = normalize_surface(x)
    return (F.char_length(s) >= min_chars) & ~s.rlike(r"^\p{N}+$") & s.rlike(r"\p{L}")


def candidate_spans(source: Column | str, min_n: int = 1, max_n: int = 5, min_chars: int = 2) -> Column:
    """Valid distinct n-grams of a text."""
    # They are normalised already, and one with a letter isn't all digits.
    return F.filter(ngrams(tokens(normalize_surface(source)), min_n, max_n), lambda s: (F.char_length(s) >= min_chars) & s.rlike(r"\p{L}"))


@functools.cache
def _case_free() -> tuple[str, str, dict[str, str]]:
    """Small letters whose case-free form is one other letter, these forms, and those of which it is several letters."""
    letters = map(chr, range(0x80, 0x20000))
    special = {c: c.casefold() for c in letters if c.lower() == c and c.casefold() != c}
    one = {c: f for c, f in special.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in special.items() if len(f) > 1}


def casefolded(x: Column | str) -> Column:
    """Text for comparisons without case; '' for null.

    Texts without any of the letters that need more than small letters, which are nearly all, take one search for them, by
    a table (a pattern of so many letters took fifty times as long as making letters small); those of ASCII alone take none.
    """
    one, forms, several = _case_free()
    small = F.lower(F.coalesce(col(x), F.lit("")))

    def folded(t: Column) -> Column:
        out = F.translate(t, one, forms)
        for c, f in several.items():
            out = F.replace(out, F.lit(c), F.lit(f))
        plain = (F.octet_length(t) == F.char_length(t)) | (F.translate(t, f"{one}{''.join(several)}", "") == t)
        return F.when(plain, t).otherwise(out)

    return let(small, folded)


def feature_text(x: Column | str) -> Column:
    """Stripped, small letters, white space collapsed."""
    return F.regexp_replace(F.lower(safe(x)), f"{BLANK}+", " ")


def feature_tokens(x: Column | str) -> Column:
    return tokens_of_feature_text(feature_text(x))


def tokens_of_feature_text(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(FEATURE_TOKEN), F.lit(0)))


def _jaccard(x: Column, y: Column) -> Column:
    # Tokens are distinct, so the size of the union follows from that of the intersection.
    both = let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both)


def _hit(x: Column, y: Column) -> Column:
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(0.0)


def jaccard_of(a: Column, b: Column) -> Column:
    """Overlap of two arrays of feature tokens, 0 if either has none."""
    return _jaccard(a, b)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two texts' feature tokens, 0 if either has none."""
    return let(feature_tokens(a), lambda x: let(feature_tokens(b), lambda y: _jaccard(x, y)))


def substring_hit(a: Column | str, b: Column | str) -> Column:
    """1 if one text holds the other, neither being empty, else 0."""
    return _hit(feature_text(a), feature_text(b))


def compared(x: Column | str) -> Column:
    """What overlaps are measured on: a text's feature text t and feature tokens w."""
    return let(feature_text(x), lambda t: F.struct(t.alias("t"), tokens_of_feature_text(t).alias("w")))


def best_overlap(one: Column, pool: Column) -> Column:
    """Best of overlap and substring hit of one ``compared`` text with any of an array, 0 if that has none that isn't empty."""
    some = F.filter(pool, lambda p: p["t"] != "")
    # An overlap is 1 at most, so none is measured where a text holds the other.
    def best(o: Column, some: Column) -> Column:
        overlap = F.array_max(F.transform(some, lambda p: _jaccard(o["w"], p["w"])))
        return F.when(F.exists(some, lambda p: _hit(o["t"], p["t"]) == 1.0), 1.0).otherwise(overlap)

    return F.coalesce(let(some, lambda s: let(one, lambda o: best(o, s))), F.lit(0.0))


def surface_overlap(source: Column | str, pool: Column) -> Column:
    """Best of overlap and substring hit of the source with any text of an array, 0 if it has none."""
    return best_overlap(compared(source), F.transform(pool, compared))


def truncated(x: Column | str, n: int) -> Column:
    """At most n characters, with '...' after a cut; '' for n of 0 or less."""
    s = safe(x)
    if n <= 0:
        return F.lit("")
    return F.when(F.char_length(s) > n, F.concat(F.regexp_replace(F.substring(s, 1, n), f"{BLANK}+$", ""), F.lit("..."))).otherwise(s)


def non_negative(x: Column | str) -> Column:
    """A number, 0 for null, NaN and below 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(col(x).cast("double"), F.lit(0.0)), F.lit(0.0)))


def ordered_distinct(items: Column | str) -> Column:
    """Stripped non-empty items of an array, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(col(items), safe), lambda s: s != ""))


def distinct_by_surface(items: Column | str) -> Column:
    """Items of an array, the first of those with an equal normalised surface; empty surfaces are left out."""

    def keep(kept: Column, item: Column) -> Column:
        known = F.transform(kept, lambda k: normalize_surface(k))
        fresh = (normalize_surface(item) != "") & ~F.array_contains(known, normalize_surface(item))
        return F.when(fresh, F.concat(kept, F.array(item))).otherwise(kept)

    return F.aggregate(F.transform(col(items), safe), F.array().cast("array<string>"), keep)


# Languages by code, and locales by language.
LANGUAGES = {"ar": "Arabic", "de": "German", "es": "Spanish", "fr": "French", "it": "Italian", "ja": "Japanese", "ko": "Korean", "th": "Thai", "tr": "Turkish", "zh": "Chinese", "en": "English"}
LOCALES = {"ar": "ar_AE", "de": "de_DE", "es": "es_ES", "fr": "fr_FR", "it": "it_IT", "ja": "ja_JP", "ko": "ko_KR", "th": "th_TH", "tr": "tr_TR", "zh": "zh_TW", "en": "en_US"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def base_language(x: Column | str) -> Column:
    """A locale's language: what stands before the first underscore."""
    return F.split_part(safe(x), F.lit("_"), F.lit(1))


def language_name(x: Column | str) -> Column:
    """English name of a language code; other codes as they are, 'target language' for none."""
    s = base_language(x)
    return F.when(s == "", "target language").otherwise(F.coalesce(_lookup(LANGUAGES, s), s))


def locale_of(x: Column | str) -> Column:
    """Locale of a language code; locales and other codes as they are."""
    s = safe(x)
    return F.coalesce(_lookup(LOCALES, s), s)


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the common start of two arrays."""
    a, b = col(a), col(b)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size(a), F.size(b)).cast("bigint"))
