"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words, small-lettered and stripped of marks, hashed into ``BUCKETS``; each weighs one
over the square root of their number's logarithm-damped size, in training as in scoring, so long texts don't drown a
single term.  The score is
the logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``: besides each term's own weight, every pair of
terms counts by the product of their factors, such as an insult that meets a group's name.

The model is fitted on the driver, on the labelled documents of the lowest hashes, whose terms come there as bucket
numbers: at most ``FIT_DOCS`` documents, and no more of them, in that order, than have ``FIT_TERMS`` terms in sum.  Texts
are fitted whole, and every text is scored whole, in one pass without a shuffle; the broadcast weights have a fixed size.

Defined cases: a null or empty text has no terms and scores by w0 alone; null labels and labels without a document
count for nothing; a document labelled more than once is toxic if any label says so; of rows of one labelled id one text
is fitted, that of the lowest hash of terms; repeated rows score alike; with
labels of one kind only, or none, the score is the share of toxic ones (0.0 without any); an empty table gives an empty
table; further columns are kept, and columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexweave.llm.arrow import as_bytes, extended, pieces, with_fields
from lexweave.llm.common import Held, cut, table

BUCKETS, FACTORS = 1 << 17, 4
FIT_DOCS, FIT_TERMS = 12_000, 8_000_000
EPOCHS, SEED = 12, 7
#: Step sizes of the bias, the weights and the factors, and what holds weights (L1) and factors (L2) down.
RATE, LINEAR_RATE, FACTOR_RATE = 0.1, 1.0, 0.02
L1, L2 = 6.0, 10.0
_MARKS = b"\"'`.,;:!?()[]{}<>#*$%&|-_"
_REMEMBERED = 300_000


class Terms(dict):
    """Bucket of a word's term; remembers those of many words."""

    def __missing__(self, word: bytes) -> int:
        term = word.strip(_MARKS)
        value = xxhash.xxh3_64_intdigest(term) % BUCKETS if term else -1
        if len(self) < _REMEMBERED:
            self[word] = value
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """A text's distinct terms' buckets."""
        words = text.lower().split() if text else []
        found = np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        return found[1:] if len(found) and found[0] < 0 else found


def weight_of(n: int) -> float:
    """Each term's value in a text of n terms."""
    return 1.0 / np.sqrt(1.0 + np.log1p(n))


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, terms: np.ndarray) -> float:
        if not len(terms):
            return float(self.bias)
        x = weight_of(len(terms))
        v = self.factors[terms]
        total = v.sum(0)
        return float(self.bias + x * self.linear[terms].sum() + 0.5 * x * x * (np.dot(total, total) - np.einsum("ij,ij->", v, v)))

    def score(self, terms: np.ndarray) -> float:
        z = self.logit(terms)
        return 0.0 if z <= -40 else 1.0 if z >= 40 else float(1.0 / (1.0 + np.exp(-z)))


def fitted(rows: list[tuple[np.ndarray, int]]) -> FactorizationMachine:
    """By gradient steps over the log loss, with positive and negative texts weighing the same in sum.

    Every term of the sample has a weight and factors.  Weights are kept small in sum (L1, follow the regularised
    leader), so that terms of one text or of chance stay near 0; factors are drawn to 0 (L2, AdaGrad), the more the
    fewer texts have their term.  Neither looks at how a term does alone, so terms that tell only in pairs are learned.
    """
    rng = np.random.default_rng(SEED)
    pos = sum(y for _, y in rows)
    share = pos / len(rows) if rows else 0.0
    if not 0 < share < 1:
        edge = 40.0 if share else -1e9
        return FactorizationMachine(edge, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    w, v, b = np.zeros(BUCKETS), rng.normal(0, 0.01, (BUCKETS, FACTORS)), 0.0
    sw, gw, gv, gb = np.zeros(BUCKETS), np.zeros(BUCKETS), np.full((BUCKETS, FACTORS), 1e-6), 1e-6
    heft = (0.5 / (1 - share), 0.5 / share)
    texts = np.bincount(np.concatenate([t for t, _ in rows]), minlength=BUCKETS)
    v[texts == 0] = 0
    decay = (L2 / np.maximum(texts, 1))[:, None]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            t, y = rows[i]
            x = weight_of(len(t)) if len(t) else 0.0
            vt, wt = v[t], w[t]
            total = vt.sum(0)
            z = b + x * wt.sum() + 0.5 * x * x * (total @ total - np.einsum("ij,ij->", vt, vt))
            e = heft[y] * (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y)
            gb += e * e
            b -= RATE * e / np.sqrt(gb)
            if len(t):
                before, after = np.sqrt(gw[t]), np.sqrt(gw[t] + (e * x) ** 2)
                led = sw[t] + e * x - (after - before) / LINEAR_RATE * wt
                sw[t], gw[t] = led, after**2
                w[t] = -np.sign(led) * np.maximum(np.abs(led) - L1, 0) * LINEAR_RATE / (1e-3 + after)
                d = e * x * x * (total - vt) + decay[t] * vt
                g = gv[t] + d * d
                gv[t] = g
                v[t] = vt - FACTOR_RATE * d / np.sqrt(g)
    return FactorizationMachine(b, w.astype(np.float32), v.astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = FIT_DOCS, most_terms: int = FIT_TERMS) -> list[tuple[np.ndarray, int]]:
    """Terms and labels of at most ``most`` labelled documents of at most ``most_terms`` terms in sum."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("k"), "k").limit(most)
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select(F.col("k").cast("string").alias("k"), F.xxhash64("k").alias("h"), "t", "y")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in pieces(batches, "t"):
            found = [terms.of(t).astype(np.int32).tobytes() for t in as_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("h"), pa.array(found, pa.binary()), batch.column("y").cast(pa.int32())], ["k", "h", "terms", "y"])

    one = F.min_by(F.struct("terms", "y"), F.xxhash64("terms")).alias("r")
    rows = cut(some.mapInArrow(reduce, "k string, h bigint, terms binary, y int").groupBy("h", "k").agg(one).select("h", "k", "r.terms", "r.y"))
    before = F.sum(F.octet_length("terms") / 4).over(Window.orderBy("h", "k"))  # at most ``most`` rows
    few = rows.withColumn("sum", before).where(F.col("sum") <= most_terms).orderBy("h", "k").select("terms", "y").toArrow()
    return [(np.frombuffer(t, np.int32).astype(np.int64), int(y > 0)) for t, y in zip(few.column("terms").to_pylist(), few.column("y").to_pylist())]


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each text."""
    rows = Held(docs, None, text)
    schema = with_fields(rows.rows.schema, [T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in pieces(batches, "t"):
            yield extended(batch, schema, {"score": [held.value.score(terms.of(t)) for t in as_bytes(batch.column("t"))]})

    return rows.back(rows.rows.mapInArrow(scan, schema).withColumnRenamed("score", out), [out])


def held_out(key: str, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == 0, F.lit(False))


def op7_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scores = toxicity_scores(docs, fitted(sample(docs, labels, "doc_id", "text", "toxic")))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
