"""Generates and evaluates predictions from the command line: ``spark-submit lexweave/evaluate.py --tables FOLDER --predictions FOLDER ...``.

Tables are Parquet folders named examples, references, entities, types and terms (see ``sources.dataset.Tables``), and
entity (qid, popularity_score) where prompts have entity memories.  Predictions are JSON lines (see ``sources.files``); of
those of one id the last in the files counts.  With a generator they are made first, and written there: it is named as
``module:function``, gets the generation options, and gives a function of prompts, once a worker.  Settings that aren't
given are those of a run's summary, if one is named.
"""

from __future__ import annotations

import argparse
import functools
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import evaluation, listwise, retrieval
from lexweave.sources import dataset, files, runs

DEFAULTS = {"split": "validation", "target_locale": None, "source_locale": None, "mode": "plain"}
PROMPTS = ("plain", "entity-aware")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("--tables", required=True)
    out.add_argument("--predictions", required=True)
    out.add_argument("--score", help="module:function that scores lists of sources, references and predictions")
    out.add_argument("--make-score", help="module:function that loads such a function, once a worker")
    out.add_argument("--summary", help="JSON file of a run, for settings that aren't given")
    out.add_argument("--metrics", help="where the metrics go; by default beside the predictions")
    out.add_argument("--limit", type=int)
    out.add_argument("--entity-type", action="append", dest="entity_types")
    for name in ("split", "target_locale", "source_locale"):
        out.add_argument(f"--{name.replace('_', '-')}")
    made = out.add_argument_group("generation")
    made.add_argument("--generator", help="module:function that makes a function of prompts; without it predictions are there already")
    made.add_argument("--mode", choices=PROMPTS, help="prompts without or with entity memories")
    made.add_argument("--entity-pipeline-mode", choices=retrieval.MODES, default="anchored")
    made.add_argument("--system")
    made.add_argument("--batch", type=int, default=8)
    for name, kind, default in (("max-new-tokens", int, 256), ("temperature", float, 0.0), ("top-p", float, 1.0)):
        made.add_argument(f"--{name}", type=kind, default=default)
    found = out.add_argument_group("retrieval and reranking")
    for name, kind, default in (("top-k", int, 10), ("per-surface-k", int, 5), ("min-chars", int, 2), ("max-n", int, 5), ("prior-weight", float, 0.1), ("alias-limit", int, 1), ("max-chars", int, 80)):
        found.add_argument(f"--{name}", type=kind, default=default)
    found.add_argument("--scorer", help="folder of a trained scorer's versions (see sources.models); without it the heuristic scores")
    return out


def named(what: str) -> Callable:
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def _made(maker: str, options: dict) -> Callable:
    return named(maker)(**options)


def generated(spark: SparkSession, args: argparse.Namespace, settings: dict, examples: DataFrame, tables: dataset.Tables) -> DataFrame:
    """Prediction records of the examples, by prompts of the mode that is set."""
    kb, more = None, {}
    if settings["mode"] == "entity-aware":
        if not settings["target_locale"]:
            raise ValueError("entity-aware prompts need a target locale")
        language = spark.range(1).select(tx.base_language(F.lit(settings["target_locale"]))).first()[0]
        kb = dataset.knowledge_base(spark.read.parquet(f"{args.tables}/entity"), tables.terms, tables.types, language)
        more = {k: getattr(args, k) for k in ("top_k", "per_surface_k", "min_chars", "max_n", "prior_weight", "alias_limit", "max_chars")}
        if args.scorer:
            more |= {"strategy": "vector", "model": listwise.best_scorer(spark, args.scorer).column}
    options = evaluation.generation_options(args.max_new_tokens, args.temperature, args.top_p)
    asked = examples.select("example_id", "source", tx.base_language("target_locale").alias("target_lang"), "gold_qid")
    rows = evaluation.predicted(asked, functools.partial(_made, args.generator, options), kb, args.entity_pipeline_mode, args.system, args.batch, **more)
    return files.prediction_records(rows.withColumn("source_lang", F.lit(settings["source_locale"]).cast("string")))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Writes the predictions, if they are to be made, and the metrics, and gives these back."""
    args = parser().parse_args(argv)
    if bool(args.score) == bool(args.make_score):
        raise ValueError("there must be --score or --make-score")
    spark = spark or SparkSession.builder.appName("lexweave-evaluate").getOrCreate()
    summary = runs.read_json(spark, args.summary) if args.summary else {}
    if "split" not in summary and summary.get("eval_split") not in (None, "", "none"):
        summary["split"] = summary["eval_split"]
    settings = runs.overlaid({k: getattr(args, k) for k in DEFAULTS}, DEFAULTS, summary)
    if settings["mode"] not in PROMPTS:
        raise ValueError(f"mode must be one of {', '.join(PROMPTS)}: {settings['mode']}")
    tables = dataset.Tables(*[spark.read.parquet(f"{args.tables}/{t}") for t in ("examples", "references", "entities", "types", "terms")])
    records = dataset.load(tables, **{k: settings[k] for k in ("split", "target_locale", "source_locale")}, limit=args.limit).withColumn("id", F.col("example_id").cast("string"))
    if args.generator:
        files.write_json_lines(generated(spark, args, settings, records, tables), args.predictions)
    predictions = files.json_lines(spark, args.predictions, files.PREDICTIONS, pattern="*.{json,jsonl,txt}", ordinal="ordinal").select("id", "prediction", "ordinal")
    row = evaluation.evaluate_predictions(predictions, records, named(args.score) if args.score else None, entity_types=args.entity_types, make_score=named(args.make_score) if args.make_score else None)
    return runs.write_metrics(row, runs.metrics_path(args.metrics, args.predictions, None), settings=settings)


if __name__ == "__main__":
    main()
