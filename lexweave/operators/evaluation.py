"""Evaluation of predictions against references: entity accuracy, translation scores, and both in one summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions.slots import Generate, Score, generated_frame, scored_frame
from lexweave.operators import linking, memory, metrics, samples


def usable_references(records: DataFrame, entity_types: list[str] | None = None) -> DataFrame:
    """Records (targets, entity_types) that have a target and, if types are asked for, any of these, capitals or not."""
    some = records.where(F.coalesce(F.size("targets") > 0, F.lit(False)))
    asked = [t.strip() for t in entity_types or [] if t.strip()]
    if not asked:
        return some
    held = F.transform(F.coalesce("entity_types", F.array().cast("array<string>")), lambda t: tx.casefolded(tx.safe(t)))
    return some.where(F.arrays_overlap(held, F.array(*[tx.casefolded(F.lit(t)) for t in asked])))


def mention_sets(records: DataFrame, order: str | None = None) -> DataFrame:
    """(id, mentions): all mentions and mention candidates of a record's targets; of records of one id the last by ``order``.

    Without ``order`` that is the one of the greatest mentions, so that the choice is the same every time.
    """
    none = F.array().cast("array<string>")
    names = F.flatten(F.transform("targets", lambda t: F.concat(F.array(t["mention"]), F.coalesce(t["mention_candidates"], none))))
    rows = records.select("id", F.sort_array(tx.ordered_distinct(F.coalesce(names, none))).alias("mentions"), F.col(order or "id").alias("_order"))
    last = F.max(F.struct("_order", "mentions"))["mentions"]
    return rows.groupBy("id").agg(last.alias("mentions"))


def evaluate_predictions(predictions: DataFrame, references: DataFrame, score: Score | None = None, scores: DataFrame | None = None, entity_types: list[str] | None = None, order: str | None = None, predictions_order: str | None = None, make_score: Callable[[], Score] | None = None) -> DataFrame:
    """One row of metrics of predictions (id, prediction) against references (id, source, targets, entity_types).

    Of predictions of one id the last counts: by ``predictions_order``, or by their column ``ordinal`` (see
    ``files.json_lines``) if they have one; without any order the greatest text does, so that the choice is always the same.
    Of records of one id it is the last by ``order``.

    score: scores (source, reference, prediction) in batches; or make_score, which loads such a function once a worker; or
    scores (id, score) that are there already, one for each reference.  A record's best reference counts, and a missing prediction counts as 0.
    """
    records = usable_references(references, entity_types)
    said = metrics.last_of(predictions, "id", "prediction", predictions_order or ("ordinal" if "ordinal" in predictions.columns else None))
    names = metrics.entity_accuracy(mention_sets(records, order), said)
    if scores is None:
        if score is None and make_score is None:
            raise ValueError("there must be scores, or a function that scores")
        pairs = records.select("id", "source", F.explode("targets").alias("t")).select("id", "source", F.col("t.translation").alias("reference")).join(said, "id")
        scores = scored_frame(pairs, score, make=make_score)
    best = metrics.best_reference_mean(scores.join(said.select("id"), "id", "left_semi"), records)
    both = names.crossJoin(best.select(F.col("mean_score").alias("comet")))  # one row each
    final = metrics.harmonic_mean("m_eta", "comet")
    return both.select(
        "m_eta", (100 * F.col("m_eta")).alias("m_eta_percent"), "correct", "total", "missing_predictions", "comet", (100 * F.col("comet")).alias("comet_percent"),
        final.alias("final_score"), (100 * final).alias("final_score_percent"),
    )


def predicted(examples: DataFrame, make: Callable[[], Generate], kb: DataFrame | None = None, mode: str = "rerank", system: str | None = None, batch: int = 8, **more: object) -> DataFrame:
    """(id, target_lang, text, prediction) of examples (example_id, source, target_lang, gold_qid); with a knowledge base prompts have entity memories."""
    rows = examples
    text = None
    if kb is not None:
        rows = linking.entity_memories(examples, kb, mode, **more)
        text = F.when(F.col("memory").isNotNull(), memory.memory_text("memory", tx.base_language("target_lang")))
    asked = samples.payload(rows, text, system).select(F.col("example_id").cast("string").alias("id"), "target_lang", F.col("source").alias("text"), "rendered_prompt")
    return generated_frame(asked, "rendered_prompt", "prediction", make, batch).drop("rendered_prompt")


def evaluate(examples: DataFrame, references: DataFrame, make: Callable[[], Generate], score: Score, kb: DataFrame | None = None, mode: str = "rerank", entity_types: list[str] | None = None, **more: object) -> tuple[DataFrame, DataFrame]:
    """Predictions of all examples, and their metrics against references (id as text)."""
    predictions = predicted(examples, make, kb, mode, **more)
    return predictions, evaluate_predictions(predictions, references, score, entity_types=entity_types)


def generation_options(max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 1.0, do_sample: bool | None = None, **explicit: object) -> dict:
    """Options of a generator: it samples if told so, or else if the temperature is above 0, and only then has one; what is explicit wins."""
    sample = temperature > 0 if do_sample is None else do_sample
    return {"max_new_tokens": max_new_tokens, "do_sample": sample} | ({"temperature": temperature, "top_p": top_p} if sample else {}) | explicit
