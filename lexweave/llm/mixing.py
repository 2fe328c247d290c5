"""Mixing sources to target weights by soft memberships.

A classifier fitted on a labelled table (naive Bayes over a text's distinct hashed words) gives each document its
posterior over the domains.  A word's evidence for a domain is its log-likelihood there against all labelled texts, shrunk to 0
where it isn't significant, so that the chance of many plain words doesn't drown a few telling ones.  Naive Bayes is too
sure of itself, the more the longer a text is, so a text's evidence is scaled by a
factor and a power of its length, those of ``EVIDENCE`` that give held-out labels the least log loss.

A document of n tokens at rate r adds r * n * posterior to its domains' expected totals.  The rates, 0 or more and
without an upper bound unless one is asked for, start at 1 and are fitted by projected gradient steps to make the
expected totals meet the targets in the least-squares sense: they minimise half the squared gap between shares of tokens
and targets, and ``RIDGE`` times half the token-weighted mean of (r - 1)^2, which makes the solution the only one and the
nearest to 1 (the weight comes down to that by tenths, each fit starting from the last).  The gradient at a document is the product of its posterior and the gap, so a step moves all rates by one
vector of as many numbers as there are domains.  Steps are scaled by the inverse of the domains' second moments over the
documents within the bounds, and the projection is taken of the sum of all steps (lazy projection): a rate is
``max(0, 1 + posterior . steps)``.  So a step needs no more than one aggregate over a small table (tokens and posterior),
whatever went before.  A step is tried at several lengths at once, and ends when the gradient vanishes wherever a rate is
within its bounds: what is then left of the gap can't be closed by any such rates.  It is warned of by domain, and
``mixed`` gives it to a caller who asks.

Memberships are soft, so each text holds a little of every domain, and targets are only within reach as far as some
texts hold more and some less.  Beyond that, least squares go on to take the few texts that come nearest to a domain many
times and leave most others out, however little that helps.  So a pipeline that doesn't know its corpus should give a
larger weight to the rates' distance from 1 (``ridge``), which trades the last of a gap for texts, bound its rates
(``most``), and take a total by which a domain that it wants whole keeps its tokens (``whole``).

Everything is column expressions: no Python on the executors.  The driver sees totals by domain only.

Defined cases: a null or empty text has no tokens, the domains' share of labelled documents as posterior and rate 1;
labels without a document count for nothing; without labels the posterior is even; a targeted domain without labels is
not fitted, and its gap warned of; equal rows get equal rates, and repeated rows (of equal key and text) one draw; an
empty table gives an empty table; further columns are kept, and columns named like new ones are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import Held, cut, let, table, words

BUCKETS = 1 << 14
#: Words that the domains' likelihoods are smoothed by, spread like all labelled texts' words; and by how many standard
#: errors a log-likelihood ratio must differ from 0 to count at all (beyond, it counts the more fully the more).
SMOOTHING, SIGNIFICANT = 1_000.0, 5.0
#: Factors and powers: evidence is multiplied by factor / length ** power, but by no more than 1.  The first where no label is held out.
EVIDENCE = ((1.0, 0.5), *[(2.0**-i, 0.0) for i in range(6)], *[(2.0**i, 0.5) for i in (-2, -1, 1, 2, 3)], *[(2.0**i, 1.0) for i in range(11)])
#: Labelled keys that the classifier is fitted on, and its evidence chosen by, at most.
FITTED, HELD_OUT = 20_000, 5_000
#: The weight of the rates' distance from 1, the gap in shares that counts as none, and the most steps.
RIDGE, CLOSE, STEPS = 1e-5, 1e-3, 60
_LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.01)
#: The query's domains, from the labelled table, and their shares of all expected tokens.  By soft memberships the check
#: tool's tables hold 0.67, 0.11 and 0.22, of which no rates make less than about 0.11 of toxic text; these are in reach.
TARGETS = {"good": 0.80, "poor": 0.05, "toxic": 0.15}


def domain_of_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, domain): toxic, else good or poor by quality; one row a key."""
    some = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("t"), F.max("quality").alias("q"))
    return some.select(key, F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "good").when(F.col("q") == 0, "poor").alias("domain")).where("domain IS NOT NULL")


def word_buckets(text: Column, n_buckets: int = BUCKETS) -> Column:
    """Buckets of a text's words, one for each word."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(n_buckets)).cast("int"))


def _softmax(logits: Column) -> Column:
    odds = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    return let(odds, lambda o: F.transform(o, lambda x: x / F.aggregate(o, F.lit(0.0), lambda s, y: s + y)))


def posteriors(rows: DataFrame, labelled: DataFrame, domains: Sequence[str], key: str = "doc_id", most: int = FITTED, held_out: int = HELD_OUT, fit_on: DataFrame | None = None) -> DataFrame:
    """Rows (k, t, ...) with ``tokens`` and ``posterior``, an array in the order of ``domains``.

    fit_on: rows (k, t) of labelled texts, by default the same rows.

    The classifier is fitted on the ``most`` labelled keys of the lowest hashes, so that they can be broadcast, of those
    that aren't held out: a fifth of all, of which up to ``held_out`` choose the evidence.
    """
    texts = (rows if fit_on is None else fit_on).select("k", "t")
    marks = labelled.where(F.col("domain").isin(*domains)).select(F.col(key).alias("k"), "domain")
    out = F.pmod(F.xxhash64("k", F.lit("held out")), F.lit(5)) == 0
    fit = marks.where(~out).orderBy(F.xxhash64("k"), "k").limit(most)
    grams = texts.join(F.broadcast(fit), "k").select("domain", F.explode(F.array_distinct(word_buckets(F.col("t")))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).cast("double").alias(f"d{i}") for i, d in enumerate(domains)])
    full = cut(rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0.0))
    n = len(domains)
    sums = full.agg(*[F.sum(f"d{i}").alias(f"t{i}") for i in range(n)]).first()
    totals = [sums[f"t{i}"] for i in range(n)]
    by_domain = {r["domain"]: r["n"] for r in fit.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = [by_domain.get(d, 0) + 1e-3 for d in domains]
    every = sum((F.col(f"d{i}") for i in range(n)), F.lit(1.0))
    share = every / (sum(totals) + BUCKETS)

    def weight(i: int) -> Column:
        """Each bucket's log-likelihood ratio in a domain, shrunk."""
        here = F.col(f"d{i}") + SMOOTHING * share
        ratio = F.log(here / (totals[i] + SMOOTHING)) - F.log(share)
        return ratio * F.greatest(F.lit(0.0), 1 - SIGNIFICANT**2 * (1 / here + 1 / every) / F.greatest(ratio * ratio, F.lit(1e-12)))

    weights = full.select("bucket", *[weight(i).alias(f"r{i}") for i in range(n)]).agg(F.sort_array(F.collect_list(F.struct("bucket", *[f"r{i}" for i in range(n)]))).alias("w"))
    columns = weights.select(F.struct(*[F.col("w").getField(f"r{i}").alias(f"r{i}") for i in range(n)]).alias("w"))

    def evident(some: DataFrame) -> DataFrame:
        """With tokens and each domain's sum of all words' evidence."""
        every = some.withColumn("_every", word_buckets(F.col("t"))).withColumn("tokens", F.size("_every").cast("double"))
        held = every.withColumn("_buckets", F.array_distinct("_every")).withColumn("_weights", columns.scalar())
        sums = lambda w: F.array(*[let(w[f"r{i}"], lambda r: F.aggregate("_buckets", F.lit(0.0), lambda s, b: s + F.get(r, b))) for i in range(n)])
        return held.withColumn("_sums", let(F.col("_weights"), sums)).withColumn("_terms", F.size("_buckets").cast("double")).drop("_every", "_buckets", "_weights")

    def posterior(factor: float, power: float) -> Column:
        scale = F.least(F.lit(1.0), F.lit(factor) / F.pow(F.greatest(F.col("_terms"), F.lit(1.0)), F.lit(power)))
        return _softmax(F.array(*[F.col("_sums")[i] * scale + float(np.log(prior[i])) for i in range(n)]))

    judges = cut(evident(texts.join(F.broadcast(marks.where(out).orderBy(F.xxhash64("k"), "k").limit(held_out)), "k")).select("domain", "_terms", "_sums"))
    place = F.array_position(F.lit(list(domains)), F.col("domain")).cast("int") - 1
    losses = judges.agg(*[F.avg(-F.log(F.greatest(F.get(posterior(*e), place), F.lit(1e-12)))).alias(f"e{i}") for i, e in enumerate(EVIDENCE)]).first()
    best = min(range(len(EVIDENCE)), key=lambda i: losses[i]) if losses[0] is not None else 0
    return evident(rows).withColumn("posterior", posterior(*EVIDENCE[best])).drop("_sums", "_terms")


@dataclass
class Rates:
    """What a rate is by posterior, the expected totals by domain that come of it, those that were to be met, and the bound."""

    steps: list[float]
    totals: list[float]
    aims: list[float]
    tokens: float
    most: float | None = None

    def column(self) -> Column:
        """The rate of rows (tokens, posterior); 1 for rows without tokens."""
        # As one array, and taken by places that aren't constant, the steps are no part of the compiled code, which serves all fits.
        steps, moved = F.lit([float(s) for s in self.steps]), F.lit(1.0)
        for i in range(len(self.steps)):
            moved = moved + F.element_at(steps, F.size("posterior") - (len(self.steps) - 1 - i)) * F.col("posterior")[i]
        held = F.greatest(F.lit(0.0), moved)
        return F.when(F.col("tokens") > 0, held if self.most is None else F.least(F.lit(float(self.most)), held)).otherwise(F.lit(1.0))

    def gap(self) -> float:
        """Summed differences of totals and aims, as a share of all tokens."""
        return sum(abs(t - a) for t, a in zip(self.totals, self.aims)) / self.tokens if self.tokens else 0.0


def fit_rates(rows: DataFrame, targets: Sequence[float], total: float | None = None, fitted: Sequence[bool] | None = None, ridge: float = RIDGE, most: float | None = None, whole: int | None = None) -> Rates:
    """Rates of ``rows`` (tokens, posterior) that meet the targets as well as rates of 0 or more, and up to ``most``, can.

    targets: shares by domain; total: of all expected tokens, by default the rows' own tokens, or with ``whole`` (a
    domain's number) so many that this domain's share is the tokens it has; fitted: which domains' targets are to be met,
    by default all.
    """
    d = len(targets)
    if most is not None and most < 1:
        raise ValueError("rates start at 1, so their bound can't be below it")
    some = np.array([i for i in range(d) if fitted is None or fitted[i]], np.int64)
    p = [F.col("posterior")[i] for i in range(d)]
    sums = rows.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in range(d)]).first()
    n = sums["n"] or 0.0
    if total is None:
        total = n if whole is None or not targets[whole] else (sums[f"t{whole}"] or 0.0) * sum(targets) / targets[whole]
    aims = np.array(targets, float) / sum(targets) * total
    if not n:
        return Rates([0.0] * d, [0.0] * d, aims.tolist(), 0.0, most)
    a = aims / n

    def measured(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each sum of steps: the rates' part of the dual loss, the shares by domain, and the second moments over rates within their bounds."""
        free = [Rates(t.tolist(), [], [], 0).column().alias(f"f{j}") for j, t in enumerate(tried)]
        held = rows.where("tokens > 0").select("tokens", "posterior", *free)
        sums, w = [], F.col("tokens")
        for j in range(len(tried)):
            f = F.col(f"f{j}")
            # Beyond the bound the loss goes on as a straight line.
            r = f if most is None else F.least(f, F.lit(float(most)))
            inside = f > 0 if most is None else (f > 0) & (f < most)
            sums += [F.sum(w * r * (2 * f - r)).alias(f"l{j}"), *[F.sum(w * r * p[i]).alias(f"e{j}_{i}") for i in range(d)]]
            sums += [F.sum(F.when(inside, w * p[i] * p[k])).alias(f"m{j}_{i}_{k}") for i in some.tolist() for k in some.tolist() if i <= k]
        got = held.agg(*sums).first()
        out = []
        for j in range(len(tried)):
            m = np.array([[got[f"m{j}_{min(i, k)}_{max(i, k)}"] or 0.0 for k in some.tolist()] for i in some.tolist()]).reshape(len(some), len(some)) / n
            out.append((0.5 * got[f"l{j}"] / n, np.array([got[f"e{j}_{i}"] for i in range(d)]) / n, m))
        return out

    taken, weight = np.zeros(d), 0.1
    part, shares, moments = measured([taken])[0]
    for _ in range(STEPS if len(some) else 0):
        gradient = weight * taken[some] + shares[some] - a[some]
        moved = False
        if np.abs(gradient).max() > (1e-9 if weight <= ridge else 1e-3):
            loss = lambda at, of: of + 0.5 * weight * float(at @ at) - float(a @ at)
            way = np.zeros(d)
            way[some] = -np.linalg.solve(moments + weight * np.eye(len(some)), gradient)
            tried = [taken + x * way for x in _LENGTHS]
            found = measured(tried)
            at = min(range(len(tried)), key=lambda j: loss(tried[j], found[j][0]))
            moved = loss(tried[at], found[at][0]) < loss(taken, part)
            if moved:
                taken, (part, shares, moments) = tried[at], found[at]
        if not moved:
            if weight <= ridge:
                break  # as close as floating-point sums can tell
            weight = max(ridge, weight / 10)
    return Rates(taken.tolist(), (shares * n).tolist(), aims.tolist(), n, most)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None, keep_text: bool = True, report: dict | None = None, most: float | None = None, whole: str | None = None, ridge: float = RIDGE, fit_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with tokens, posterior, rate and copies: how often a document is to be taken, its rate on average.

    labels: key and domain.  The whole part of a rate is taken for sure, the rest by a hash of key and text.  The rows are
    written to the shared folder once; keep_text=False leaves the texts out of that.  report: gets each domain's expected
    tokens and those aimed at.  total, most, whole and ridge: as for ``fit_rates``.  fit_on: labelled texts (key and text) to
    fit the classifier on, by default those among ``docs``.
    """
    held = Held(docs, key, text)
    rows = posteriors(held.rows, labels, list(targets), key, fit_on=None if fit_on is None else Held(fit_on, key, text).rows).withColumn("_draw", F.xxhash64(F.lit("mix"), "k", "t"))
    rows = cut(rows if keep_text else rows.drop("t"))
    known = {r["domain"] for r in labels.where(F.col("domain").isin(*targets)).select("domain").distinct().collect()}
    rates = fit_rates(rows, list(targets.values()), total, [d in known for d in targets], ridge, most, None if whole is None else list(targets).index(whole))
    if report is not None:
        report.update({d: (t, a) for d, t, a in zip(targets, rates.totals, rates.aims)})
    if rates.gap() > CLOSE:
        said = ", ".join(f"{d}: {t:.6g} of {a:.6g}" for d, t, a in zip(targets, rates.totals, rates.aims))
        warnings.warn(f"the mix misses its targets; expected tokens by domain: {said}", stacklevel=2)
    draw = F.shiftrightunsigned("_draw", 11) / F.lit(float(1 << 53))
    out = rows.withColumn("rate", rates.column())
    out = out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("bigint"))
    return held.back(out, ["tokens", "posterior", "rate", "copies"])


def op9_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixed(docs, domain_of_labels(table(spark, sf_dir, "labels")), TARGETS, keep_text=False)
    return out.select("doc_id", F.col("tokens").cast("bigint").alias("n_tokens"), *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate", "copies")
