"""The registered queries of retrieval, reranking, memory, prompts and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as tx
from lexweave.operators import evaluation, linking, listwise, memory, metrics, rerank, retrieval, samples
from lexweave.operators.alignment import align, legacy_span
from lexweave.plans.bindings import benchmark_kb, document_examples, order_examples, part_kb, part_terms, read
from lexweave.sources import dataset, files, shared


def normalize_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", tx.normalize_surface("text").alias("surface"))
    return rows.select("doc_id", "surface", F.size(tx.tokens("surface")).alias("n_tokens"))


def span_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = retrieval.example_spans(document_examples(spark, sf_dir), 3, 5)
    return spans.groupBy("example_id", tx.token_count("surface").alias("n")).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.char_length("surface")).alias("n_chars"))


def surface_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.surface_index(benchmark_kb(spark, sf_dir)).select("surface", "qid", "target_lang", "popularity")


def ambiguity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ambiguity(retrieval.surface_index(part_kb(spark, sf_dir)))


def surface_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.candidates(document_examples(spark, sf_dir), benchmark_kb(spark, sf_dir), mode="surface", min_n=3, fields=())
    return found.select("example_id", "rank", "qid", F.col("source_span").alias("surface"), "ambiguity_count")


def _part_candidates(spark: SparkSession, sf_dir: str, mode: str = "rerank", fields: tuple[str, ...] = ()) -> DataFrame:
    return retrieval.candidates(order_examples(spark, sf_dir), part_kb(spark, sf_dir), mode=mode, fields=fields)


def surface_topk_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_candidates(spark, sf_dir, "surface").select("example_id", "rank", "qid", "source_span", "ambiguity_count")


def anchored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_candidates(spark, sf_dir, "anchored", ("target_label", "entity_type", "popularity")).select("example_id", "qid", "target_label", "entity_type", "popularity")


def retrieve_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_candidates(spark, sf_dir, "retrieve").select("example_id", "qid", "candidate_source")


def candidate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_candidates(spark, sf_dir).select("example_id", "rank", "qid", "candidate_source", "source_span")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = order_examples(spark, sf_dir)
    return linking.aligned(retrieval.candidates(examples, linking.named(linking.prepared(part_kb(spark, sf_dir))), more=(linking._NAMES, linking._ENTITY), carry=linking.carried()), examples)


def align_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("example_id", "qid", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), "span.matched_text", "span.match_kind", "span.match_score")


def align_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a part of their second word, and their fifth word in capitals as an alias: matches inside words, and none."""
    word = lambda n: F.coalesce(F.get(F.split(F.coalesce("text", F.lit("")), " "), n), F.lit(""))
    large = F.translate(word(4), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rows = read(spark, sf_dir, "documents").select("doc_id", align("text", F.substring(word(1), 2, 3), F.array(large)).alias("span"))
    return rows.select("doc_id", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), "span.matched_text", "span.match_kind", "span.match_score")


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.featured(_aligned(spark, sf_dir))


def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _featured(spark, sf_dir).select("example_id", "qid", *[F.round(F.col(f"f_{f}"), 6).alias(f) for f in rerank.FEATURES])


def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the candidates of each order by name, with the gold part as the prior."""
    first = F.first_value("span_text").over(Window.partitionBy("example_id").orderBy("rank"))
    found = _aligned(spark, sf_dir)
    rows = (found if "passed_span" in found.columns else found.withColumn("passed_span", first)).withColumn("_score", F.col("span.match_score")).withColumn("_kind", F.col("span.match_kind"))
    record = rerank.feature_record("source", "span_text", "_score", "_kind", "passed_span", "gold_qid", **linking.made(rows))
    return rows.select("example_id", *[v.alias(n) for n, v in record.items()])


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.scored(_featured(spark, sf_dir))


def rerank_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("example_id", "qid", "reranker_score", F.round("final_score", 6).alias("final_score"), "final_rank")


def margin_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).where("final_rank = 1").select("example_id", "qid", F.round("margin_to_next", 6).alias("margin_to_next"))


def _memories(spark: SparkSession, sf_dir: str, mode: str = "anchored") -> DataFrame:
    return linking.entity_memories(order_examples(spark, sf_dir), part_kb(spark, sf_dir), mode)


def pipeline_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode of the pipeline remembers of each order."""
    rows = linking.entity_memories_by_mode(order_examples(spark, sf_dir), part_kb(spark, sf_dir), retrieval.MODES)
    return rows.select("example_id", "mode", "memory.qid", "memory.source_span", "memory.canonical_target")


def gold_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of the orders' gold parts; parts of size 20 or more are taken to be unknown."""
    known = part_kb(spark, sf_dir).join(read(spark, sf_dir, "part").where("p_size < 20").select(F.concat(F.lit("P"), "p_partkey").alias("qid")), "qid", "left_semi")
    rows = linking.gold_memories(order_examples(spark, sf_dir), known)
    return rows.select("example_id", "candidate_source", memory.memory_text("memory", "target_lang").alias("memory_text"))


def entity_memory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memories(spark, sf_dir).select("example_id", memory.memory_text("memory", "target_lang").alias("memory_text"))


def translation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("memory").isNotNull(), memory.memory_text("memory", "target_lang"))
    return _memories(spark, sf_dir).select("example_id", memory.translation_prompt("source", "target_lang", text).alias("prompt"))


def plain_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", memory.translation_prompt("text", "lang").alias("prompt"))


def noisy_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir).where("memory IS NOT NULL")
    return rows.select("example_id", *[memory.memory_text(memory.noisy("memory", n), "target_lang").alias(n) for n in memory.NOISES])


def sft_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.samples(_memories(spark, sf_dir), mode="entity-memory", target="target_label")


def plain_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("source"), F.col("source").alias("target"), F.concat_ws("_", "lang", F.lit("XX")).alias("target_lang"))
    return samples.samples(rows)


def noisy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.samples(_memories(spark, sf_dir), mode="entity-memory", noise="drop_description", target="target_label")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a chat: the system's message, then all turns in order."""
    rows = read(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    turns = rows.groupBy("conv_id").agg(dataset.ordered_list(F.struct("role", tx.safe("text").alias("content")), "turn", F.when(F.col("role") == "user", 0).otherwise(1)).alias("turns"))
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(memory.SYSTEM).alias("content")))
    return turns.select("conv_id", memory.rendered_chat(F.concat(system, "turns"), open_answer=False).alias("chat"))


def _turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, p, f): for each assistant's turn the ids of all that was said before, and of that and the answer.

    Words' lengths stand for token ids, as a tokenizer is the user's choice.
    """
    ids = F.transform(tx.tokens(tx.normalize_surface("text")), lambda w: F.char_length(w))
    said = read(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "role", ids.alias("ids"))
    before = F.flatten(F.collect_list("ids").over(Window.partitionBy("conv_id").orderBy("turn", F.desc("role")).rowsBetween(Window.unboundedPreceding, -1)))
    return said.withColumn("p", before).where("role = 'assistant'").select("conv_id", "turn", "p", F.concat("p", "ids").alias("f"))


def completion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _turn_ids(spark, sf_dir).select("conv_id", "turn", memory.completion_labels("p", "f", 0, 2048).alias("labels")).where("labels IS NOT NULL")
    return out.select("conv_id", "turn", F.size("labels").alias("n_labels"), F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def _hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.training_rows(order_examples(spark, sf_dir), part_kb(spark, sf_dir))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hard(spark, sf_dir).select("example_id", "candidate_rank_in_group", "qid", "label")


def grouped_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features (as texts of six decimals), labels and identifiers of each order's candidates to train on, in order."""
    groups = _groups(spark, sf_dir)
    # Decimals of six places print as %.6f does, in a fraction of the time; numbers without that many digits of their own go the other way.
    six = lambda x: F.when((x >= 0) & (x < 1e9), F.round(x, 6).cast("decimal(17,6)").cast("string")).otherwise(F.format_string("%.6f", F.round(x, 6)))
    numbers = F.transform("numeric_features", lambda v: F.array_join(F.transform(v, six), ","))
    return groups.select("example_id", F.array_join(numbers, "|").alias("numeric_features"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.array_join("qids", ",").alias("qids"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.training_groups(order_examples(spark, sf_dir), part_kb(spark, sf_dir))


def reranker_mlp(spark: SparkSession, sf_dir: str, epochs: int = 10, steps: int = 4) -> DataFrame:
    """Scores by a scorer that is trained on all groups where they are."""
    groups, held = _groups(spark, sf_dir), shared.folder(spark)
    model = listwise.trained(groups, epochs, steps, rate=1e-2, kept=held).scorer
    rows = spark.read.schema(groups.schema).parquet(held).select("example_id", F.explode(F.arrays_zip("numeric_features", "qids")).alias("c"))
    return rows.select("example_id", F.col("c.qids").alias("qid"), model.column(F.col("c.numeric_features")).alias("score"))


#: A scorer of two hidden units with fixed weights.
FIXED = rerank.ListwiseScorer(np.array([[0.5, -0.25]] + [[0.125, 0.25]] * 4 + [[0.0625, -0.125]] * 4 + [[0.001, 0.0], [-0.5, 0.25]]), np.array([0.25, -0.5]), np.array([1.0, -2.0]), 0.125)


def fixed_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the candidates to train on by a scorer of fixed weights, in Arrow batches."""
    rows = _hard(spark, sf_dir).withColumn("features", F.transform(rerank.vector(linking.feature_columns()), lambda x: F.round(x, 6)))
    return rows.select("example_id", "qid", F.round(FIXED.column(F.col("features")), 11).alias("score"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without the gold entity as an anchored candidate."""
    examples, kb, modes = order_examples(spark, sf_dir), part_kb(spark, sf_dir), ("rerank", "surface")
    found = retrieval.candidates_of_modes(examples, kb, modes, carry=retrieval.Carry(lambda some: some, lambda key: key), fields=())
    # Where candidates know their example's gold entity, only that one goes on.
    ranks = metrics.gold_ranks_by(examples, found.where("qid = gold_qid") if "gold_qid" in found.columns else found, "mode", modes)
    name = F.when(F.col("mode") == "rerank", "anchored_and_surface").otherwise("surface_only")
    return ranks.groupBy(name.alias("candidates")).agg(*[F.round(c, 9).alias(n) for n, c in metrics.recall_at((1, 3, 5, 10)).items()])


def legacy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of each order's parts and brands that stands in the name of the part it is asked of."""
    named = order_examples(spark, sf_dir).join(part_kb(spark, sf_dir).select(F.col("qid").alias("gold_qid"), "target_label", "target_aliases"), "gold_qid")
    return named.select("example_id", legacy_span(F.upper("source"), F.split_part("target_label", F.lit(" "), F.lit(1)), F.concat("target_aliases", F.array(F.split_part("target_label", F.lit(" "), F.lit(2))))).alias("span"))


def reranker_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reranked(spark, sf_dir)
    ranks = rows.where("qid = gold_qid").select("example_id", F.col("final_rank").alias("gold_rank"))
    out = metrics.ranking_summary(ranks)
    return out.select("n_groups", *[F.round(c, 9).alias(c) for c in out.columns if c != "n_groups"])


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents ask for the first words of the test item that their number names; English texts are predictions.

    Numbers go round by the number of items, counted, so that each is asked for; they are in the order of the items' ids.
    """
    benchmark = read(spark, sf_dir, "benchmark")
    # Items are few a bucket of ids: numbered within it, and the buckets, by their order, laid end to end.
    bucket = benchmark.select("item_id", "text", F.floor(F.col("item_id") / 4096).alias("_b"))
    starts = bucket.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("item_id")) - 1
    items = bucket.withColumn("_nth", nth).join(starts, "_b").select((F.col("_start") + F.col("_nth")).alias("_item"), tx.tokens(tx.normalize_surface("text")).alias("_w"))
    asked = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).withColumn("_item", F.pmod("id", benchmark.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar())).join(items, "_item")
    mentions = asked.select("id", F.array(F.get("_w", 0), F.array_join(F.slice("_w", 1, 2), " ")).alias("mentions"))
    return mentions, read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"))


def m_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entity_accuracy(*_mentions(spark, sf_dir)).select("correct", "total", "missing_predictions", F.round("m_eta", 9).alias("m_eta"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the labelled documents: their sources' and languages' names as mentions, their kinds as entity types."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), "lang", F.col("source").alias("site"))
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    first = tx.first_token("source")
    target = F.struct(F.col("lang").alias("translation"), F.coalesce(first, F.lit("none")).alias("mention"), F.array("site").alias("mention_candidates"))
    types = F.array(F.when(F.col("q") == 1, "Good").otherwise("POOR"), F.when(F.col("x") == 1, "Toxic").otherwise("clean"))
    return docs.join(labels, "id").select("id", "source", F.array(target).alias("targets"), types.alias("entity_types"))


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents but German ones predict themselves, and are scored by their language; of records only good ones count."""
    records = _references(spark, sf_dir)
    predictions = read(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"))
    scores = records.select("id", F.explode("targets.translation").alias("t")).select("id", F.when(F.col("t") == "en", 0.75).otherwise(0.5).alias("score"))
    out = evaluation.evaluate_predictions(predictions, records, scores=scores, entity_types=["gOOd"])
    return out.select("correct", "total", "missing_predictions", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("correct", "total", "missing_predictions")])


def mention_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mention_sets(_references(spark, sf_dir)).select("id", F.array_join("mentions", "|").alias("mentions"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.lit(1.0) - F.col("l_discount")).alias("score"))
    return metrics.best_reference_mean(scores, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


def comet_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("matched", "missing", F.round("mean_score", 9).alias("mean_score"))


def harmonic_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics.entity_accuracy(*_mentions(spark, sf_dir)).select("m_eta", F.lit(1).alias("one")).join(_scores(spark, sf_dir).select("mean_score", F.lit(1).alias("one")), "one")
    return both.select(F.round(metrics.harmonic_mean("m_eta", "mean_score"), 9).alias("harmonic_mean"))


def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("source_lang"), F.col("lang").alias("target_lang"), "text", F.col("text").alias("prediction"))
    return files.prediction_records(rows)


def _order_tables(spark: SparkSession, sf_dir: str) -> dataset.Tables:
    """Orders as examples (their states as splits), lineitems as references and entities, parts as types and terms."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    orders = read(spark, sf_dir, "orders")
    return dataset.Tables(
        orders.select(F.col("o_orderkey").alias("example_id"), F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("source_locale"), F.lit("en").alias("target_locale"), F.col("o_orderpriority").alias("source")),
        lines.select(F.col("l_orderkey").alias("example_id"), F.col("l_partkey").alias("reference_id"), F.concat("l_returnflag", "l_linestatus").alias("translation_text"), F.lit(None).cast("string").alias("mention_text"), F.col("l_linenumber").alias("reference_order")),
        lines.select(F.col("l_orderkey").alias("example_id"), F.concat(F.lit("P"), "l_partkey").alias("qid"), F.col("l_linenumber").alias("entity_order")),
        part.select(F.concat(F.lit("P"), "p_partkey").alias("qid"), F.col("p_type").alias("type_text")), part_terms(spark, sf_dir),
    )


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(
        "example_id", "target", "gold_qid", F.greatest(F.size("targets"), F.lit(0)).alias("n_targets"), F.get("targets", 0)["mention"].alias("mention"),
        F.array_join("entity_qids", ",").alias("qids"), F.array_join("entity_types", ",").alias("types"), F.array_join(F.get("targets", 0)["mention_candidates"], ",").alias("mention_candidates"),
    )


def dataset_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _order_tables(spark, sf_dir)
    return _told(dataset.assembled(t.examples, t.references, t.entities, t.types, t.terms, require_references=False, require_mentions=False))


def dataset_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished urgent orders."""
    return _told(dataset.load(_order_tables(spark, sf_dir), split="F", source_locale="1-URGENT", require_references=False, require_mentions=False))


def dataset_load_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred open orders, as a scan with a limit gives them."""
    return _told(dataset.load(_order_tables(spark, sf_dir), split="O", limit=100, require_references=False, require_mentions=False))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    return rows.groupBy("l_orderkey").agg(F.array_join(tx.ordered_distinct(dataset.ordered_list("p_type", "l_linenumber", "p_partkey")), ",").alias("types"))


def kb_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    entity = part.select(F.concat(F.lit("P"), "p_partkey").alias("qid"), F.col("p_retailprice").alias("popularity_score"))
    types = part.select(F.concat(F.lit("P"), "p_partkey").alias("qid"), F.col("p_brand").alias("type_text"))
    rows = dataset.knowledge_base(entity, part_terms(spark, sf_dir), types, "fr")
    return rows.select("qid", "label_en", F.array_join("aliases_en", ",").alias("aliases_en"), "target_label", "entity_type", "description", "language_available", "popularity", F.array_join("surfaces", "|").alias("surfaces"))


def upsert_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that an append adds to what the purchases have stored: one for each user and type."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type")
    stored = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"))
    return files.missing_from(events, stored, ["user_id", "event_type"])


def custom_term_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first term of each entity, labels before aliases."""
    kind = F.when(F.col("term_type") == "label", 0).otherwise(1)
    terms = part_terms(spark, sf_dir).where("term_type IN ('label', 'alias') AND lang_code = 'en'")
    return terms.groupBy("qid").agg(F.array_join(dataset.ordered_list("term_text", kind, "term_id"), "|").alias("terms"))


def explode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(dataset.ordered_list(F.concat(F.lit("P"), "l_partkey"), "l_linenumber", "l_partkey").alias("entities"))
    feed = rows.select(F.col("id").cast("string").alias("id"), F.lit("x").alias("source"), F.lit("en").alias("target_locale"), "entities")
    return files.train_examples(feed).select("example_id", "gold_qid")


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the events' JSON texts, by type."""
    rows = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return dataset.filtered(rows, o_orderstatus="F", o_orderpriority=None)


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nations' regions, all kept: the shape of entities and their types."""
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey", "left").select("c_custkey", "n_name", "r_name")


QUERIES = (
    normalize_surface, span_ngrams, surface_index, ambiguity_count, surface_topk, surface_topk_ambiguous, anchored_lookup, retrieve_top1, candidate_list, align_spans,
    rerank_features, rerank_heuristic, margin_to_next, entity_memory_text, translation_prompt, plain_prompt, noisy_memory, sft_samples, chat_messages, completion_labels,
    align_variants, pipeline_modes, gold_memories, plain_samples, noisy_samples, feature_records, fixed_scorer, legacy_spans, evaluation_summary, mention_sets, dataset_load, dataset_load_first,
    hard_negatives, grouped_training_rows, reranker_mlp, retrieval_recall, reranker_mrr, m_eta, comet_aggregate, harmonic_final, prediction_records, dataset_assembly,
    ordered_distinct, kb_build, upsert_antijoin, custom_term_order, explode_entities, event_keys, filtered_orders, nation_regions,
)
