"""Metrics of retrieval, ranking and translation, each one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as tx


def gold_ranks(examples: DataFrame, candidates: DataFrame) -> DataFrame:
    """(example_id, gold_rank) of the examples that have a gold entity; null rank if it wasn't found."""
    gold = examples.where(tx.safe("gold_qid") != "").select("example_id", F.col("gold_qid").alias("qid"))
    return gold.join(candidates.select("example_id", "qid", "rank"), ["example_id", "qid"], "left").groupBy("example_id").agg(F.min("rank").alias("gold_rank"))


def gold_ranks_by(examples: DataFrame, candidates: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """(example_id, by, gold_rank), as ``gold_ranks`` for each of several values of a column of the candidates."""
    gold = examples.where(tx.safe("gold_qid") != "").select("example_id", F.col("gold_qid").alias("qid"), F.explode(F.array(*[F.lit(v) for v in values])).alias(by))
    return gold.join(candidates.select("example_id", "qid", by, "rank"), ["example_id", "qid", by], "left").groupBy("example_id", by).agg(F.min("rank").alias("gold_rank"))


def recall_at(ks: Sequence[int], rank: Column | str = "gold_rank") -> dict[str, Column]:
    return {f"recall_at_{k}": F.coalesce(F.avg(F.coalesce(tx.col(rank) <= k, F.lit(False)).cast("double")), F.lit(0.0)) for k in ks}


def ranking_summary(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5), rank: str = "gold_rank") -> DataFrame:
    """One row: groups, top-1 accuracy, mean reciprocal rank and recalls."""
    rr = F.when(F.col(rank).isNull(), 0.0).otherwise(1.0 / F.col(rank))
    top1 = F.coalesce(F.avg(F.coalesce(F.col(rank) == 1, F.lit(False)).cast("double")), F.lit(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("n_groups"), top1.alias("top1_accuracy"), F.coalesce(F.avg(rr), F.lit(0.0)).alias("mrr"), *[c.alias(n) for n, c in recall_at(ks, rank).items()])


def last_of(rows: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """(key, value): of rows of one key the last by ``order``, or else the greatest value."""
    if order is None:
        return rows.groupBy(key).agg(F.max(value).alias(value))
    return rows.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))["v"].alias(value))


def entity_accuracy(mentions: DataFrame, predictions: DataFrame, skip_empty: bool = False, order: str | None = None) -> DataFrame:
    """One row of correct, total, missing_predictions and m_eta: predictions that hold any of their references' mentions.

    mentions: id, mentions (array); predictions: id, prediction.  Missing predictions count as wrong, others are ignored.
    Of rows of one id the last by ``order`` counts.  Rows without a mention raise an error, or are skipped if told so.
    """
    asked = last_of(mentions, "id", "mentions", order).select("id", tx.ordered_distinct(F.coalesce("mentions", F.array().cast("array<string>"))).alias("mentions"))
    named = F.size("mentions") > 0
    asked = asked.where(named) if skip_empty else asked.where(F.when(named, True).otherwise(F.raise_error(F.concat(F.lit("no mentions for "), F.col("id").cast("string"))).cast("boolean")))
    said = last_of(predictions.withColumn("prediction", F.coalesce("prediction", F.lit(""))), "id", "prediction", order)
    folded = tx.casefolded("prediction")
    rows = asked.join(said, "id", "left").select(tx.let(folded, lambda p: F.exists("mentions", lambda m: F.contains(p, tx.casefolded(m)))).alias("hit"), F.col("prediction").isNull().alias("gone"))
    hit = F.coalesce(F.col("hit") & ~F.col("gone"), F.lit(False)).cast("int")
    return rows.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if("gone").alias("missing_predictions"),
        F.coalesce(F.sum(hit) / F.count(F.lit(1)), F.lit(0.0)).alias("m_eta"),
    )


def best_reference_mean(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: the mean over ``ids`` of each one's best score over its references; ids without a score count as 0."""
    best = scores.groupBy("id").agg(F.max("score").alias("best"))
    rows = ids.select("id").distinct().join(best, "id", "left")
    return rows.agg(F.count("best").alias("matched"), F.count_if(F.col("best").isNull()).alias("missing"), F.coalesce(F.sum("best") / F.count(F.lit(1)), F.lit(0.0)).alias("mean_score"))


def harmonic_mean(a: Column | str, b: Column | str) -> Column:
    """0 if either is 0 or less."""
    a, b = tx.col(a), tx.col(b)
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(2 * a * b / (a + b))
