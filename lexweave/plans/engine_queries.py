"""The registered queries of feeds, appends, fallbacks, batches, training and generation, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import evaluation, linking, listwise, memory, metrics, retrieval, samples
from lexweave.plans.bindings import order_examples, part_kb, read
from lexweave.plans.entity_queries import FIXED, _groups, _order_tables, _told, _turn_ids
from lexweave.plans.entity_sql import ASSEMBLY, FEATURED_OWN, HARD, LANGUAGE, MEMORIES, ONLY_SURFACE, PARTS, PROMPT, SPANS, TURN_IDS, VECTOR, norm, parts_query, strip
from lexweave.sources import dataset, files, runs, shared
from lexweave.sources.keyed import KeyedTable


def _evaluation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an evaluation feed, written as JSON lines and read back: their languages as locales, sources as entities."""
    first = F.get(tx.tokens(tx.normalize_surface("text")), 0)
    target = F.struct(F.substring("text", 1, 40).alias("translation"), first.alias("mention"))
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.lit("en").alias("source_locale"), F.col("lang").alias("target_locale"), F.concat(F.lit("Q"), "source").alias("wikidata_id"),
        F.array("lang", "source").alias("entity_types"), F.array(target, F.struct(F.col("lang").alias("translation"), F.col("source").alias("mention"))).alias("targets"),
    ).withColumnRenamed("text", "source")
    held = f"{shared.folder(spark)}/evaluation"
    files.write_json_lines(rows, held)
    return files.json_lines(spark, held, files.EVAL, pattern="*.txt")


def _train_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as a training feed, written as JSON lines and read back: their numbers as entities."""
    qid = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    rows = read(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("en").alias("source_locale"), F.col("role").alias("target_locale"), F.substring("text", 1, 30).alias("source"), F.substring("text", 1, 20).alias("target"),
        F.array(qid("conv_id"), qid("turn")).alias("entities"),
    )
    held = f"{shared.folder(spark)}/train"
    files.write_json_lines(rows, held)
    return files.json_lines(spark, held, files.TRAIN, pattern="*.txt")


def feed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.references(_train_feed(spark, sf_dir), _evaluation_feed(spark, sf_dir))


def feed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of both feeds, with their types."""
    train, evaluated = _train_feed(spark, sf_dir), _evaluation_feed(spark, sf_dir)
    return files.entities(train, evaluated).join(files.entity_types(evaluated), "qid", "left").select("qid", "popularity_score", "type_text")


def feed_example_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of entities in the feeds' examples, by the number that an examples' table gives these; the last of equal names counts."""
    train, evaluated = _train_feed(spark, sf_dir), _evaluation_feed(spark, sf_dir)
    known = read(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("example_id"), F.col("doc_id").cast("string").alias("dataset_id"))
    known = known.unionByName(known.withColumn("example_id", F.col("example_id") + 1))
    return dataset.with_example_ids(files.example_entities(train, evaluated), known).select("example_id", "dataset_id", "qid", "entity_order")


def qid_locale_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of both feeds as one JSON array, written by partitions in order and read back."""
    path = f"{shared.folder(spark)}.json"
    runs.write_json_array(files.qid_locale_pairs(_train_feed(spark, sf_dir), _evaluation_feed(spark, sf_dir)), path)
    return files.qid_locales(spark, path)


#: Names that fields go by in a feed.
VARIED = {"id": ("bigint", ("id", "example_id", "$.meta.id")), "source": ("string", ("source", "text", "sentence")), "locale": ("string", ("target_locale", "lang", "$.meta.locale"))}


def varied_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines whose fields have three sets of names, by number; every seventh line is cut short, and so corrupt."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    one = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.lit("").alias("text"), F.col("lang").alias("target_locale")))
    two = F.to_json(F.struct(F.col("doc_id").alias("example_id"), F.col("text"), F.lit(" ").alias("source"), F.col("lang")))
    three = F.to_json(F.struct(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("locale")).alias("meta"), F.col("text").alias("sentence")))
    line = F.when(F.pmod("doc_id", F.lit(3)) == 0, one).when(F.pmod("doc_id", F.lit(3)) == 1, two).otherwise(three)
    cut = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.substring(line, 1, 12)).otherwise(line)
    held = shared.folder(spark)
    rows.select(cut.alias("value")).write.text(held)
    return files.varied_lines(spark, held, VARIED, pattern="*.txt")


def last_in_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions of their users: of each the last in the file."""
    rows = files.with_ordinal(read(spark, sf_dir, "events"), "ordinal")
    return metrics.last_of(rows, "user_id", "event_id", "ordinal")


def duplicate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as predictions in JSON lines, of which the last of a conversation counts: it must hold its own first word."""
    rows = read(spark, sf_dir, "conversations").where("role IN ('user', 'assistant') AND text IS NOT NULL")
    held = f"{shared.folder(spark)}/predictions"
    lines = rows.select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("prediction"), F.col("turn").alias("_turn")).repartitionByRange(F.col("id")).sortWithinPartitions("id", "_turn")
    files.write_json_lines(lines.drop("_turn"), held)
    predictions = files.json_lines(spark, held, files.PREDICTIONS, pattern="*.txt", ordinal="ordinal")
    last = rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    word = F.coalesce(F.try_element_at(tx.tokens(tx.normalize_surface("text")), F.lit(-1)), F.lit("none"))
    records = last.select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("source"), F.array(F.struct(F.lit("x").alias("translation"), word.alias("mention"), F.array(F.lit("").cast("string")).alias("mention_candidates"))).alias("targets"), F.array().cast("array<string>").alias("entity_types"))
    scores = records.select("id", F.lit(0.5).alias("score"))
    out = evaluation.evaluate_predictions(predictions.select("id", "prediction", "ordinal"), records, scores=scores)
    return out.select("correct", "total", "missing_predictions", F.round("m_eta", 9).alias("m_eta"))


def keyed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in four batches by number, one of them twice, to a table that keeps the first of each user and type."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    table = KeyedTable(shared.folder(spark), ("user_id", "event_type"), 32)
    for batch in (0, 1, 2, 2, 3):
        some = rows.where(F.pmod("event_id", F.lit(4)) == batch)
        table.append(some.withColumn("_order", F.col("event_id")), "events", batch, "_order")
    return table.rows(spark, "user_id bigint, event_type string, event_id bigint").select("user_id", "event_type", "event_id")


def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of some nations' customers in these nations' languages, for all that fall back on them: a nation on those of half
    and of a third of its number."""
    nation = read(spark, sf_dir, "nation")
    named = nation.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("fallback"))
    steps = [nation.select(F.col("n_name").alias("lang_code"), F.floor(F.col("n_nationkey") / d).alias("_k"), F.lit(d - 2).alias("place")).where("n_nationkey > 0") for d in (2, 3)]
    chain = files.fallback_chain(steps[0].unionByName(steps[1]).join(named, "_k").select("lang_code", "fallback", "place"))
    customer = read(spark, sf_dir, "customer").where("c_nationkey % 5 = 1")
    terms = customer.join(named, F.col("c_nationkey") == F.col("_k")).select(F.col("c_mktsegment").alias("qid"), F.col("fallback").alias("lang_code"), F.lit("label").alias("term_type"), F.col("c_name").alias("term_text"))
    return files.terms_with_fallback(terms, chain)


def saved_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled orders, written in the run that finds out whether any lacks a reference or a mention, and read back."""
    t, path = _order_tables(spark, sf_dir), shared.folder(spark)
    some = t.examples.join(t.references.select("example_id"), "example_id", "left_semi")
    rows = dataset.assembled(some, t.references, t.entities, t.types, t.terms, require_references=False, require_mentions=False)
    dataset.save(rows, path)
    return _told(spark.read.schema(rows.schema).parquet(path))


def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of conversations in batches of eight of about the same length, padded."""
    ids = _turn_ids(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("example_id"), F.slice(F.concat("f", F.array(F.lit(0))), 1, 2048).alias("full_ids"), memory.completion_labels("p", "f", 0, 2048).alias("labels"))
    text = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), "|")
    out = samples.batched(ids, 8)
    return out.select("batch", "size", "width", text("input_ids").alias("input_ids"), text("attention_mask").alias("attention_mask"), text("batch_labels").alias("batch_labels"), F.array_join("keys", ",").alias("keys"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the tokens of samples made of documents: the words of prompt and target, at most 2,048."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("source"), F.col("source").alias("target"), F.col("lang").alias("target_lang"))
    made = samples.tokenized(samples.samples(rows), lambda: lambda texts: [[len(w) for w in t.split()] for t in texts], 2048, 0)
    return samples.sample_counts(made)


def generated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' prompts with anchored memories, answered by a generator that tells their lines and characters."""
    rows = evaluation.predicted(order_examples(spark, sf_dir), lambda: lambda prompts: [f"{p.count(chr(10))} {len(p)}" for p in prompts], part_kb(spark, sf_dir), "anchored")
    return files.prediction_records(rows.withColumn("source_lang", F.lit(None).cast("string"))).select("id", "source_language", "target_language", "prediction")


def listwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss and top-1 accuracy of the scorer of fixed weights over all groups, summed where the groups are."""
    groups = _groups(spark, sf_dir).withColumn("numeric_features", F.transform("numeric_features", lambda v: F.transform(v, lambda x: F.round(x, 6))))
    found = listwise.judged(groups, FIXED)
    row = (found["groups"], None if found["loss"] is None else round(found["loss"], 6), None if found["top1"] is None else round(found["top1"], 9))
    return spark.createDataFrame([row], "n_groups bigint, loss double, top1 double")


def first_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines of one part the first, and all lines of discounted parts, which have no identifier."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.when(F.col("l_discount") < 0.05, F.col("l_partkey").cast("string")).alias("qid"), F.struct("l_linenumber", "l_suppkey").alias("rank"))
    return retrieval.first_by_qid(rows).select("example_id", "qid", F.col("rank.l_linenumber").alias("line"))


def gold_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two first surface candidates of each order, and its usable gold part as the last where it isn't among them."""
    examples, kb = order_examples(spark, sf_dir), part_kb(spark, sf_dir)
    return linking.with_gold(retrieval.candidates(examples, kb, mode="surface", top_k=2), examples, kb).select("example_id", "rank", "qid")


def templated_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by a chat template that marks each role's turns, ready for a tokenizer."""
    turns = read(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").groupBy("conv_id").agg(dataset.ordered_list(F.struct("role", tx.safe("text").alias("content")), "turn", F.when(F.col("role") == "user", 0).otherwise(1)).alias("m"))
    signs = {"user": ("<|user|>\n", "<|end|>\n"), "assistant": ("<|assistant|>\n", "<|end|>\n")}
    return turns.select("conv_id", samples.templated("m", signs, "<|begin|>\n", "<|assistant|>\n").alias("chat"))


def split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished urgent orders loaded and mapped to plain samples at once."""
    tables = _order_tables(spark, sf_dir)
    return samples.split_samples(tables, "F", source_locale="1-URGENT", require_references=False)


QUERIES = (
    feed_references, feed_entities, feed_example_entities, qid_locale_array, varied_feed, last_in_input, duplicate_predictions, keyed_append, language_fallback, saved_examples, training_batches, token_counts,
    generated_predictions, listwise_loss, first_by_entity, gold_rescue, templated_chat, split_samples,
)

_FEEDS = f"""
ev AS (SELECT doc_id::VARCHAR AS id, lang, source, substr(text, 1, 40) AS said, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '')[1] AS first FROM documents),
tr AS (SELECT conv_id || '-' || turn AS id, role, substr(text, 1, 20) AS target, 'Q' || conv_id AS q0, 'Q' || turn AS q1 FROM conversations)
"""

SQL = {
    "feed_references": f"""WITH {_FEEDS} SELECT id AS dataset_id, target AS translation_text, NULL::VARCHAR AS mention_text, 0::INT AS reference_order FROM tr
      UNION ALL SELECT id, said, first, 0::INT FROM ev UNION ALL SELECT id, lang, source, 1::INT FROM ev""",
    "feed_entities": f"""WITH {_FEEDS}, q AS (SELECT q0 AS qid FROM tr UNION SELECT q1 FROM tr UNION SELECT 'Q' || source FROM ev), t AS (SELECT DISTINCT 'Q' || source AS qid, unnest([lang, source]) AS type_text FROM ev)
      SELECT qid, NULL::DOUBLE AS popularity_score, type_text FROM q LEFT JOIN t USING (qid) WHERE qid IS NOT NULL""",
    "feed_example_entities": f"""WITH {_FEEDS}, e AS (SELECT id, q0 AS qid, 0 AS o FROM tr UNION ALL SELECT id, q1, 1 FROM tr UNION ALL SELECT id, 'Q' || source, 0 FROM ev)
      SELECT doc_id * 2 + 1 AS example_id, id AS dataset_id, qid, o::INT AS entity_order FROM e JOIN (SELECT DISTINCT doc_id FROM documents) ON doc_id::VARCHAR = id""",
    "qid_locale_array": f"""WITH {_FEEDS} SELECT q0 AS qid, role AS locale FROM tr UNION SELECT q1, role FROM tr UNION SELECT 'Q' || source, lang FROM ev""",
    "varied_feed": f"""SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE nullif({strip('text')}, '') END AS source, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS locale,
      CASE WHEN doc_id % 7 = 0 THEN substr(CASE doc_id % 3 WHEN 0 THEN '{{"id":' || doc_id || ',"source' WHEN 1 THEN '{{"example_id":' ELSE '{{"meta":{{"id":' END, 1, 12) END AS corrupt FROM documents WHERE text IS NOT NULL""",
    "last_in_input": "SELECT user_id, arg_max(event_id, r) AS event_id FROM (SELECT user_id, event_id, row_number() OVER () AS r FROM events) GROUP BY user_id",
    "duplicate_predictions": f"""WITH l AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY conv_id),
      w AS (SELECT text, coalesce(list_filter(string_split({norm('text')}, ' '), lambda w: w <> '')[-1], 'none') AS word FROM l)
      SELECT count_if(contains(lower(text), word))::BIGINT AS correct, count(*) AS total, 0::BIGINT AS missing_predictions, round(coalesce(avg(contains(lower(text), word)::INT), 0.0), 9) AS m_eta FROM w""",
    "keyed_append": "SELECT user_id, event_type, arg_min(event_id, (event_id % 4) * 1000000000000 + event_id) AS event_id FROM events GROUP BY 1, 2",
    "language_fallback": """WITH RECURSIVE s AS (SELECT a.n_name AS lang, b.n_name AS fb, p AS place FROM nation a, (SELECT unnest([0, 1]) AS p) JOIN nation b ON b.n_nationkey = a.n_nationkey // (p + 2)
        WHERE a.n_nationkey > 0),
      one AS (SELECT lang, fb, min(place) AS place FROM s GROUP BY 1, 2),
      way AS (SELECT n AS lang, n AS fb, 0 AS d, []::INT[] AS w, [n] AS seen FROM (SELECT lang AS n FROM one UNION SELECT fb FROM one)
        UNION ALL SELECT way.lang, one.fb, d + 1, list_append(w, place), list_append(seen, one.fb) FROM way JOIN one ON one.lang = way.fb WHERE NOT list_contains(seen, one.fb) AND d < 6),
      best AS (SELECT lang, fb, d, w FROM way QUALIFY row_number() OVER (PARTITION BY lang, fb ORDER BY d, w) = 1),
      c AS (SELECT lang, fb, row_number() OVER (PARTITION BY lang ORDER BY d, w, fb) AS r FROM best),
      t AS (SELECT c_mktsegment AS qid, n_name AS fb, c_name AS term_text FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 5 = 1),
      n AS (SELECT qid, lang, fb, r, term_text FROM t JOIN c USING (fb))
      SELECT qid, lang AS lang_code, 'label' AS term_type, term_text, fb AS from_lang FROM n QUALIFY r = min(r) OVER (PARTITION BY qid, lang)""",
    "saved_examples": ASSEMBLY.format(where="WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "training_batches": f"""WITH {TURN_IDS},
      a AS (SELECT conv_id || '-' || turn AS k, list_append(list_concat(p, ids), 0)[1:2048] AS f, list_append(list_concat(list_transform(p, lambda x: -100), ids), 0)[1:2048] AS l FROM i WHERE role = 'assistant'),
      n AS (SELECT *, row_number() OVER (ORDER BY len(f), md5(k), f) - 1 AS pos FROM a WHERE len(list_filter(l, lambda x: x <> -100)) > 0),
      b AS (SELECT *, pos // 8 AS batch, max(len(f)) OVER (PARTITION BY pos // 8) AS width FROM n),
      r AS (SELECT *, list_resize(f, width, 0) AS ids, list_resize(list_transform(f, lambda x: 1), width, 0) AS mask, list_resize(l, width, -100) AS labels FROM b)
      SELECT batch::BIGINT AS batch, count(*)::INT AS size, max(width)::INT AS width, string_agg(array_to_string(ids, ','), '|' ORDER BY pos) AS input_ids, string_agg(array_to_string(mask, ','), '|' ORDER BY pos) AS attention_mask,
        string_agg(array_to_string(labels, ','), '|' ORDER BY pos) AS batch_labels, string_agg(k, ',' ORDER BY pos) AS keys FROM r GROUP BY batch""",
    "token_counts": f"""WITH s AS (SELECT '[TASK]' || chr(10) || 'Translate the following sentence into ' || {LANGUAGE} || ' naturally and accurately.' || chr(10) || chr(10) || '[SOURCE]' || chr(10) || {strip('text')} AS p, {strip('source')} AS t
        FROM documents WHERE {strip('text')} <> '' AND {strip('source')} <> '' AND {strip('lang')} <> ''),
      n AS (SELECT len(list_filter(regexp_split_to_array(p, '[\\x09-\\x0D\\x20\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: w <> '')) AS a, len(list_filter(regexp_split_to_array(t, '[\\x09-\\x0D\\x20\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: w <> '')) AS b FROM s),
      k AS (SELECT least(a, 2048) AS pl, least(a + b, 2048) AS fl FROM n),
      c AS (SELECT least(fl + 1, 2048) AS l, least(pl, fl) AS m FROM k)
      SELECT count(*) AS samples, count_if(l > m)::BIGINT AS kept, count_if(l <= m)::BIGINT AS skipped, coalesce(sum(CASE WHEN l > m THEN l END), 0)::BIGINT AS tokens, coalesce(sum(CASE WHEN l > m THEN l - m END), 0)::BIGINT AS target_tokens,
        coalesce(max(CASE WHEN l > m THEN l END), 0)::INT AS longest FROM c""",
    "generated_predictions": f"""WITH {PARTS}, {MEMORIES}, m AS (SELECT example_id, '[USER]' || chr(10) || {PROMPT} || chr(10) || chr(10) || '[ASSISTANT]' AS p FROM txt)
      SELECT example_id::VARCHAR AS id, 'en_US' AS source_language, 'en_US' AS target_language, (length(p) - length(replace(p, chr(10), ''))) || ' ' || length(p) AS prediction FROM m""",
    "listwise_loss": parts_query(
        f"""SELECT count(*) AS n_groups, round(avg(loss), 6) AS loss, round(avg(top1), 9) AS top1 FROM (
          SELECT example_id, ln(sum(exp(s - m))) - (max(CASE WHEN y = 1 THEN s END) - max(m)) AS loss, (arg_min(y, place) FILTER (WHERE s = m)) AS top1 FROM (
            SELECT *, max(s) OVER (PARTITION BY example_id) AS m FROM (
              SELECT example_id, place, y, 0.125 + greatest(0, 0.25 + 0.5 * v[1] + 0.125 * (v[2] + v[3] + v[4] + v[5]) + 0.0625 * (v[6] + v[7] + v[8] + v[9]) + 0.001 * v[10] - 0.5 * v[11])
                - 2 * greatest(0, -0.5 - 0.25 * v[1] + 0.25 * (v[2] + v[3] + v[4] + v[5]) - 0.125 * (v[6] + v[7] + v[8] + v[9]) + 0.25 * v[11]) AS s FROM (SELECT *, {VECTOR}::DOUBLE[] AS v FROM hard)))
          GROUP BY example_id HAVING max(y) = 1)""", SPANS, FEATURED_OWN, HARD
    ),
    "first_by_entity": """SELECT l_orderkey AS example_id, qid, l_linenumber AS line FROM (SELECT *, CASE WHEN l_discount < 0.05 THEN l_partkey::VARCHAR END AS qid FROM lineitem)
      QUALIFY qid IS NULL OR row_number() OVER (PARTITION BY l_orderkey, qid ORDER BY l_linenumber, l_suppkey) = 1""",
    "gold_rescue": parts_query(
        """SELECT example_id, rank::INT AS rank, qid FROM cand UNION ALL SELECT a.example_id, (coalesce(n, 0) + 1)::INT, a.qid FROM anch a LEFT JOIN (SELECT example_id, max(rank) AS n FROM cand GROUP BY 1) m USING (example_id)
        WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.example_id = a.example_id AND c.qid = a.qid)""", cand=ONLY_SURFACE, k=2
    ),
    "templated_chat": f"""SELECT conv_id, '<|begin|>' || chr(10) || string_agg('<|' || role || '|>' || chr(10) || {strip('text')} || '<|end|>' || chr(10), '' ORDER BY turn, role DESC) || '<|assistant|>' || chr(10) AS chat
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""",
    "split_samples": f"""SELECT example_id, '[TASK]' || chr(10) || 'Translate the following sentence into English naturally and accurately.' || chr(10) || chr(10) || '[SOURCE]' || chr(10) || '1-URGENT' AS prompt, target, 'plain' AS mode
      FROM ({ASSEMBLY.format(where="WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")}) WHERE target IS NOT NULL""",
}
