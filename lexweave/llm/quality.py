"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Words and word pairs are hashed into ``BUCKETS`` buckets.  Two multinomials are counted over them: one over trusted
documents (a bounded sample of those labelled good), one over all documents.  A document's score is the mean over its n-grams of
``ln p_trusted(bucket) - ln p_raw(bucket)``, and a document passes if its score reaches a threshold.  The threshold is
the cut that parts labelled documents of good and bad quality best (where a share of good ones lost weighs
``GOOD_WEIGHT`` times a share of bad ones kept), found from a histogram of all their scores, so it is the same on
every run over the same tables.  Labels are dealt in two by a hash of their id: one half is trusted from, the threshold
is cut by the other, whose scores the trusted multinomial hasn't seen.  Without labels of both kinds in that half the
threshold is minus infinity, and only the base rules decide.

Base rules: too few words, or too many words in five-word windows that the text repeats.

All counts and scores are column expressions.  The only thing that leaves the executors is the table of bucket weights,
``BUCKETS`` rows whatever the corpus's size.

Defined cases: a null or empty text has no words and fails the base rules; labels without a document, and null labels,
count for nothing; a document labelled more than once is trusted if any label says so; repeated rows are scored alike;
an empty table gives an empty table; further columns are kept, and columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import Held, cut, let, table, words

BUCKETS = 10_000
#: Added to each bucket's count, in both multinomials.
PRIOR = 1.0
#: Scores are cut at multiples of this, from -STEPS to STEPS of them.
STEP, STEPS = 0.01, 600
GOOD_WEIGHT = 4.0
#: The trusted multinomial is fitted on so many trusted ids at most, those of the lowest hashes.
TRUSTED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def pair_hashes(hashes: Column) -> Column:
    """Hash of each word with the next, from their hashes; the last word has none."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1)))


def log_ratios(docs: DataFrame, text: str, trusted: Column, n_buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, llr) for every bucket, from the counts over trusted rows and over all rows."""
    hashes = let(let(words(F.col(text)), word_hashes), lambda h: F.concat(h, pair_hashes(h)))
    grams = docs.select(trusted.cast("int").alias("_trusted"), F.explode(hashes).alias("_h"))
    counts = grams.groupBy(F.pmod("_h", F.lit(n_buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("trusted"))
    every = docs.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket")
    full = every.join(counts, "bucket", "left").select("bucket", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + prior).alias(c) for c in ("raw", "trusted")])
    sums = Window.partitionBy(F.lit(0))  # n_buckets rows
    return full.select("bucket", (F.log(F.col("trusted") / F.sum("trusted").over(sums)) - F.log(F.col("raw") / F.sum("raw").over(sums))).alias("llr"))


def mean_ratio(hashes: Sequence[Column], ratios: DataFrame, n_buckets: int = BUCKETS) -> tuple[Column, Callable[[Column], Column]]:
    """The weights as one array, and the mean by that array of the weights of arrays of hashes (null if they are empty)."""
    weights = ratios.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "llr"))), lambda x: x["llr"]).alias("w"))

    def mean(w: Column) -> Column:
        total = F.lit(0.0)
        for h in hashes:
            total = F.aggregate(h, total, lambda s, x: s + F.get(w, F.pmod(x, F.lit(n_buckets)).cast("int")))
        return total / F.nullif(sum((F.size(h) for h in hashes), F.lit(0)), F.lit(0))

    return weights.scalar(), mean


def repeated_words(w: Column, pairs: Column, window: int = WINDOW) -> Column:
    """Words inside windows of five words found twice or more in an array of words.

    Most texts repeat no window, which shows in their hashes alone.  For others the windows are sorted by hash, those
    equal to a neighbour, word by word, are kept, and the words they cover are counted from the gaps between them.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda a, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - a, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)

    def twice(hashes: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return F.coalesce((a["h"] == b["h"]) & (F.slice(w, a["i"], window) == F.slice(w, b["i"], window)), F.lit(False))

        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))

        def kept(s: Column) -> Column:
            near = F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(near, lambda x: x["i"]))

        return let(let(keyed, kept), covered)

    # A window's hash is made of those of its pairs: the first, the third and the fourth cover five words.
    hashes = F.transform(F.slice(pairs, 1, F.greatest(F.size(pairs) - (window - 2), F.lit(0))), lambda h, i: F.xxhash64(h, F.get(pairs, i + 2), F.get(pairs, i + 3)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(twice(h)))


#: The columns that ``measured`` adds.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_score", "base_failed")


def measured(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """Rows (k, t, rest) with the counts of the base rules, ``base_failed`` and ``llr_score``."""
    t = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    weights, mean = mean_ratio([F.col("_hashes"), F.col("_pairs")], ratios)
    out = rows.withColumn("_words", words(F.col("t"))).withColumn("_hashes", word_hashes(F.col("_words"))).withColumn("_pairs", pair_hashes(F.col("_hashes"))).withColumn("_weights", weights)
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.when(t.rlike("[#*$%&|<>]"), F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).otherwise(0).cast("bigint"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": repeated_words(F.col("_words"), F.col("_pairs")),
            "llr_score": let(F.col("_weights"), mean),
        }
    ).drop("_words", "_hashes", "_pairs", "_weights")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def best_cut(labelled: DataFrame, score: str, good: Column) -> float:
    """The score that parts good from bad rows best; the lowest of equal ones."""
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(F.col(score) / STEP).cast("int")))
    bins = labelled.where(F.col(score).isNotNull()).groupBy(step.alias("bin")).agg(F.sum(good.cast("int")).alias("g"), F.sum((~good).cast("int")).alias("b"))
    rows = sorted(bins.collect())  # at most 2 * STEPS + 1 rows
    goods, bads = sum(r["g"] for r in rows), sum(r["b"] for r in rows)
    if not goods or not bads:
        return float("-inf")
    best, at, g, b = -1.0, float("-inf"), goods, 0
    for r in rows:
        if GOOD_WEIGHT * g / goods + b / bads > best + 1e-12:
            best, at = GOOD_WEIGHT * g / goods + b / bads, r["bin"] * STEP
        g, b = g - r["g"], b + r["b"]
    return at


def quality_verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``llr_score`` and ``kept``.

    labels: ``key`` and quality, 1 or 0.  The measured rows are written to the shared folder, as the cut must know all
    labelled scores before the first verdict; keep_text=False leaves the texts out of that.  Filters on the verdict stop
    at the written rows, too: pushed into the measures, they would evaluate them again for each word.
    """
    held = Held(docs, key, text)
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("quality").alias("q"))
    fits = F.pmod(F.xxhash64("k", F.lit("trusted")), F.lit(2)) == 0
    # At most TRUSTED ids, so that they can be broadcast and no text is shuffled.
    trusted = marks.where(fits & (F.col("q") == 1)).orderBy(F.xxhash64("k"), "k").limit(TRUSTED).select("k", F.lit(True).alias("trusted"))
    ratios = cut(log_ratios(held.rows.select("k", "t").join(F.broadcast(trusted), "k", "left"), "t", F.coalesce("trusted", F.lit(False))))
    rows = measured(held.rows, ratios)
    rows = cut(rows if keep_text else rows.drop("t"))
    at = best_cut(rows.where(~F.col("base_failed")).select("k", "llr_score").join(marks.where(~fits), "k"), "llr_score", F.col("q") == 1)
    out = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr_score") >= F.lit(at), F.lit(False)))
    return held.back(out, [*MEASURES, "kept"])


def op5_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdicts = quality_verdicts(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), keep_text=False)
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score")


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and verdicts alone, which SQL can express."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    none = spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0.0).alias("llr"))
    return measured(docs, none).select(F.col("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ORACLE_BASE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (SELECT r, p, array_to_string(ws[p : p + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
), twice AS (SELECT r, p FROM pos QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), rep AS (SELECT r, count(DISTINCT p + o) AS n FROM (SELECT r, p, unnest(range(0, 5)) AS o FROM twice) GROUP BY r
), ln AS (SELECT r, len(l) - len(list_distinct(l)) AS n FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w))
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, ln.n::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
       (len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws)) AS base_failed
FROM w JOIN ln USING (r) LEFT JOIN rep USING (r)
"""
