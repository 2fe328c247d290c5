"""From examples and a knowledge base to scored candidates and entity memories: the pipeline of any mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as tx
from lexweave.operators import memory, rerank, retrieval
from lexweave.operators.alignment import align, align_names, align_surface, folds_alike, legacy_span, small, variants


#: Columns that are made once an example or once a row of the knowledge base, for alignment and features.
_ENTITY, _NAMES = "_entity", "_names"
#: Columns of aligned candidates that features are made of.
_MADE = ("_made", "_span_made", "_passed_made", _ENTITY)


def prepared(kb: DataFrame) -> DataFrame:
    """A knowledge base with what features need of its entities, made before it meets candidates."""
    return kb.withColumn(_ENTITY, rerank.prepared_entity())


def named(kb: DataFrame, min_chars: int = 2) -> DataFrame:
    """A knowledge base with the names that alignment looks for, made before it meets candidates."""
    return kb.withColumn(_NAMES, variants("label_en", "aliases_en", min_chars))


def _read(examples: DataFrame) -> DataFrame:
    """Examples with what their candidates need of the source, made once an example."""
    some = examples.withColumn("_text", tx.safe("source"))
    return some.select("*", small(F.col("_text")).alias("_small"), folds_alike(F.col("_text")).alias("_plain"), rerank.prepared_source("_text").alias("_made"))


def carried(min_chars: int = 2) -> retrieval.Carry:
    """What candidates keep to be aligned and compared without meeting their examples again, for ``retrieval.candidates_of_modes``.

    The anchored one is aligned once an example, and what texts are compared by is made once an example or a row of the index.
    """

    def added(some: DataFrame) -> DataFrame:
        span = align_names(F.col("_text"), F.col("_small"), F.col("_plain"), F.col(f"_anchor.{_NAMES}"))
        rows = _read(some).withColumn("_anchor_span", F.when(F.col("_anchor").isNotNull(), span))
        return rows.withColumn("_anchor_own", tx.compared("_anchor_span.matched_text"))

    return retrieval.Carry(added, lambda x: F.struct(tx.compared(x).alias("made"), small(x).alias("small"), folds_alike(x).alias("plain")))


def aligned(found: DataFrame, examples: DataFrame, min_chars: int = 2) -> DataFrame:
    """Candidates with their examples' source and gold_qid, and their spans in it.

    A surface candidate's own n-gram is aligned, an anchored one's names.  span_text is the n-gram, or else what matched.
    A source is stripped, folded and cut into tokens once, before it meets its candidates.  Candidates that carry their
    examples (see ``carried``) have passed_span, the first one's span_text, too.
    """
    kept = "_anchor_span" in found.columns
    rows = found if kept else found.join(_read(examples.select("example_id", "source", "gold_qid")), "example_id")
    by_surface = F.col("source_span").isNotNull()
    known = (F.col("_own.small"), F.col("_own.plain")) if kept else ()
    span = F.when(by_surface, align_surface("_text", "source_span", F.col("_small"), F.col("_plain"), *known))
    span = (span.when(F.col("_is_anchor"), F.col("_anchor_span")) if kept else span).otherwise(align("_text", "label_en", "aliases_en", min_chars))
    out = rows.withColumn("span", span)
    if kept:
        passed = F.when(F.col("_anchor_first"), F.coalesce(F.col("_anchor_span.matched_text"), F.lit(""))).otherwise(F.col("_first_span"))
        own = F.when(by_surface, F.col("_own.made")).when(F.col("_is_anchor"), F.col("_anchor_own")).otherwise(tx.compared("span.matched_text"))
        passed_own = F.when(F.col("_anchor_first"), F.col("_anchor_own")).otherwise(F.col("_first_own.made"))
        out = out.withColumns({"passed_span": passed, "_span_made": own, "_passed_made": passed_own}).drop("_anchor_span", "_anchor_own", "_is_anchor", "_anchor_first", "_first_span", "_own", "_first_own")
    return out.drop("_text", "_small", "_plain", _NAMES).withColumn("span_text", F.coalesce("source_span", F.col("span.matched_text"), F.lit("")))


def _features(rows: DataFrame, passed_span: str | None = None) -> dict[str, Column]:
    """Features of aligned candidates, by what was prepared of them."""
    return {f"f_{k}": v for k, v in rerank.features("source", "span_text", "_score", passed_span, **made(rows)).items()}


def made(rows: DataFrame) -> dict[str, Column]:
    """What was prepared of aligned candidates, as ``rerank.features`` takes it."""
    names = {"source_made": "_made", "entity": _ENTITY, "own_made": "_span_made", "passed_made": "_passed_made"}
    return {k: F.col(c) for k, c in names.items() if c in rows.columns}


def featured(rows: DataFrame, by: Sequence[str] = ("example_id",), where: Column | None = None) -> DataFrame:
    """Aligned candidates with their features, as ``f_`` columns; the first candidate's span is passed to all of an example.

    where: the rows that overlaps are measured for, by default all; others' are null.
    """
    first = F.first_value("span_text").over(Window.partitionBy(*by).orderBy("rank"))
    named = (rows if "passed_span" in rows.columns else rows.withColumn("passed_span", first)).withColumn("_score", F.col("span.match_score"))
    return _with_features(named, "passed_span", where).drop("_score", *_MADE)


def _with_features(rows: DataFrame, passed_span: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows with their features; overlaps, which are dear, become columns before others are made of them."""
    made = _features(rows, passed_span)
    dear = [f"f_{c}" for c in ("surface_overlap_score", "description_overlap_score", "span_match_score")]
    made["f_context_suitability"] = rerank.context(*[F.col(c) for c in dear])
    return rows.withColumns({c: made[c] if where is None else F.when(where, made[c]) for c in dear}).withColumns({c: v for c, v in made.items() if c not in dear})


def feature_columns() -> dict[str, Column]:
    return {f: F.col(f"f_{f}") for f in rerank.FEATURES}


def scored(rows: DataFrame, strategy: str = "heuristic", model: Callable[[Column], Column] | None = None, prior_weight: float = rerank.PRIOR_WEIGHT, by: Sequence[str] = ("example_id",)) -> DataFrame:
    """Featured candidates with reranker_score, prior_bonus, final_score, final_rank and margin_to_next."""
    if strategy in ("features", "vector") and model is not None:
        # A column of its own, which the condition that always holds keeps Spark from moving into the model's call: it can't
        # call Python on arguments that are lambda functions' results.
        rows = rows.withColumn("_input", F.when(F.monotonically_increasing_id() >= 0, rerank.model_input(feature_columns(), strategy)))
        score = model(F.col("_input"))
    else:
        score = rerank.score(feature_columns(), strategy, model)
    out = rows.withColumn("reranker_score", F.round(score, 6)).withColumn("prior_bonus", rerank.prior("qid", "gold_qid")).drop("_input")
    return rerank.reranked(out, weight=prior_weight, by=by)


def selected_by_mode(
    examples: DataFrame, kb: DataFrame, modes: Sequence[str], index: DataFrame | None = None, top_k: int = 10, per_surface_k: int = 5, min_n: int = 1, max_n: int = 5, min_chars: int = 2,
    strategy: str = "heuristic", model: Callable[[Column], Column] | None = None, prior_weight: float = rerank.PRIOR_WEIGHT,
) -> DataFrame:
    """The candidate of each example that each mode chooses, aligned, with the column ``mode``, of one lookup for all modes."""
    reranks = "rerank" in modes
    known = named(prepared(kb) if reranks else kb, min_chars)
    found = retrieval.candidates_of_modes(examples, known, modes, index, top_k, per_surface_k, min_n, max_n, min_chars, (_NAMES, _ENTITY) if reranks else (_NAMES,), carried(min_chars))
    rows = aligned(found.where((F.col("mode") == "rerank") | (F.col("rank") == 1)), examples, min_chars)
    if not reranks:
        return rows.drop(*_MADE)
    keys = ("example_id", "mode")
    best = scored(featured(rows, keys, F.col("mode") == "rerank"), strategy, model, prior_weight, keys)
    return best.where(F.when(F.col("mode") == "rerank", F.col("final_rank") == 1).otherwise(F.col("rank") == 1))


def selected(examples: DataFrame, kb: DataFrame, mode: str = "rerank", **more: object) -> DataFrame:
    """The candidate of each example that a mode chooses, aligned; examples without candidates have no row.

    more: as for ``selected_by_mode``.
    """
    return selected_by_mode(examples, kb, (mode,), **more).drop("mode")


def entity_memories_by_mode(examples: DataFrame, kb: DataFrame, modes: Sequence[str], alias_limit: int = 1, max_chars: int = 80, **more: object) -> DataFrame:
    """All examples, once a mode (column ``mode``), with ``memory``, that of the candidate which the mode chooses; null for none.

    more: as for ``selected_by_mode``.
    """
    if tuple(modes) == ("anchored",) and more.get("top_k", 10) >= 1:
        return _anchored_memories(examples, kb, alias_limit, max_chars, more.get("min_chars", 2))
    best = selected_by_mode(examples, kb, modes, **more).select("example_id", "mode", "qid", "target_label", "target_aliases", "entity_type", "description", "span_text")
    block = memory.memory_block("source", "span_text", "qid", "target_label", "target_aliases", "entity_type", "description", alias_limit, max_chars)
    asked = examples.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return asked.join(best.withColumn("_found", F.lit(True)), ["example_id", "mode"], "left").select(*examples.columns, "mode", F.when(F.col("_found"), block).alias("memory"), tx.safe("target_label").alias("target_label"))


def _anchored_memories(examples: DataFrame, kb: DataFrame, alias_limit: int, max_chars: int, min_chars: int) -> DataFrame:
    """``entity_memories_by_mode`` of anchored candidates alone: examples meet their gold entities as whole rows, made once.

    Rows of one id have one entity, that of the greatest identifier among their usable ones; each has its own source's span of it.
    """
    fields = ("target_label", "target_aliases", "entity_type", "description", _NAMES)
    best = retrieval.anchor_rows(named(kb, min_chars), fields).select(F.col("qid").alias("_gold"), "target_lang", F.struct("qid", *fields).alias("_own"))
    asks = (tx.safe("source") != "") & (tx.safe("target_lang") != "")
    rows = examples.withColumn("_gold", F.when(asks, tx.or_null("gold_qid"))).join(best, ["_gold", "target_lang"], "left")
    rows = rows.withColumn("_anchor", F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_gold"))).over(Window.partitionBy("example_id")))
    found = F.col("_anchor").isNotNull()
    rows = rows.withColumn("_text", tx.safe("source"))
    span = align_names(F.col("_text"), small(F.col("_text")), folds_alike(F.col("_text")), F.col(f"_anchor.{_NAMES}"))
    rows = rows.withColumn("_span", F.coalesce(F.when(found, span)["matched_text"], F.lit("")))
    block = memory.memory_block("source", "_span", *[f"_anchor.{c}" for c in ("qid", "target_label", "target_aliases", "entity_type", "description")], alias_limit, max_chars)
    return rows.select(*examples.columns, F.lit("anchored").alias("mode"), F.when(found, block).alias("memory"), tx.safe("_anchor.target_label").alias("target_label"))


def entity_memories(examples: DataFrame, kb: DataFrame, mode: str = "rerank", alias_limit: int = 1, max_chars: int = 80, **more: object) -> DataFrame:
    """All examples with ``memory``, that of the candidate which the mode chooses; null for none."""
    return entity_memories_by_mode(examples, kb, (mode,), alias_limit, max_chars, **more).drop("mode")


def gold_memories(examples: DataFrame, kb: DataFrame, alias_limit: int = 1, max_chars: int = 80) -> DataFrame:
    """Examples with the memory of their primary entity, as training samples have it, and where it comes from.

    An entity that the knowledge base lacks makes a memory of its identifier alone (``fallback_qid_only``).  Its span is
    the longest of its English names that occurs in the source.  examples: gold_qid, and perhaps entity_qids.
    """
    qids = F.col("entity_qids") if "entity_qids" in examples.columns else F.array().cast("array<string>")
    named = examples.withColumn("qid", primary_qid("gold_qid", qids))
    nth = F.row_number().over(Window.partitionBy("qid", "target_lang").orderBy(F.desc("popularity"), "target_label"))
    fields = ("label_en", "aliases_en", "target_label", "target_aliases", "entity_type", "description")
    records = kb.withColumn("_nth", nth).where("_nth = 1").select("qid", "target_lang", *fields, F.lit(True).alias("_found"))
    rows = named.join(records, ["qid", "target_lang"], "left")
    block = memory.memory_block("source", legacy_span("source", "label_en", "aliases_en"), "qid", "target_label", "target_aliases", "entity_type", "description", alias_limit, max_chars)
    kind = F.when(F.col("_found"), "gold_qid_lookup").otherwise("fallback_qid_only")
    return rows.select(*examples.columns, "qid", block.alias("memory"), kind.alias("candidate_source"))


def primary_qid(gold: Column | str, entity_qids: Column | str) -> Column:
    """The identifier that is given, or else the first of a list that isn't empty; '' for none."""
    return tx.first_non_empty(gold, F.get(F.filter(tx.col(entity_qids), lambda q: tx.safe(q) != ""), 0))


def with_gold(found: DataFrame, examples: DataFrame, kb: DataFrame) -> DataFrame:
    """Candidates, and for examples whose gold entity is usable but not among them, that one as the last."""
    missing = retrieval.candidates(examples, kb, mode="anchored", more=[c for c in (_ENTITY,) if c in found.columns]).join(found.select("example_id", "qid"), ["example_id", "qid"], "left_anti")
    last = found.groupBy("example_id").agg(F.max("rank").alias("_last"))
    rescued = missing.join(last, "example_id", "left").withColumn("rank", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    return found.unionByName(rescued.select(*found.columns))


def _training_candidates(examples: DataFrame, kb: DataFrame, rescue: bool = False, **more: object) -> DataFrame:
    """Aligned candidates with ``f_`` features, without a passed span, and with the rounded scores that order them."""
    found = retrieval.candidates(examples, named(prepared(kb)), more=(_ENTITY,) if rescue else (_NAMES, _ENTITY), carry=None if rescue else carried(), **more)
    rows = aligned(with_gold(found, examples, prepared(kb)) if rescue else found, examples).withColumn("_score", F.col("span.match_score"))
    return _with_features(rows).drop(*_MADE).withColumns({c: F.round(f"f_{c}", 6) for c in ("surface_overlap_score", "span_match_score")})


def training_rows(examples: DataFrame, kb: DataFrame, max_negatives: int = 8, rescue: bool = False, **more: object) -> DataFrame:
    """Candidates to train a scorer on: each example's gold one (label 1) and its hardest others, with ``f_`` features and places.

    No span is passed, as there is none in training: candidates are compared with their own.  rescue: a usable gold
    entity that wasn't found is added.  more: as for ``retrieval.candidates``.
    """
    return rerank.hard_negatives(_training_candidates(examples, kb, rescue, **more), F.col("gold_qid"), max_negatives)


def training_groups(examples: DataFrame, kb: DataFrame, max_negatives: int = 8, **more: object) -> DataFrame:
    """(example_id, numeric_features, labels, qids): the rows to train on, one for each example."""
    return rerank.hard_groups(_training_candidates(examples, kb, **more).withColumn("features", rerank.vector(feature_columns())), F.col("gold_qid"), max_negatives)
