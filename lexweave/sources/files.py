"""Feeds in files: JSON lines of training and evaluation sentences, identifier lists, captured entity documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as tx
from lexweave.sources import shared
from lexweave.sources.keyed import first_of_keys

# The feeds' schemas.
TRAIN = "id string, source_locale string, target_locale string, source string, target string, entities array<string>"
EVAL = "id string, source string, source_locale string, target_locale string, wikidata_id string, entity_types array<string>, targets array<struct<translation: string, mention: string>>"
QID_LOCALES = "qid string, locale string"
NAMED = "map<string, struct<value: string>>"
ENTITIES = f"entities map<string, struct<missing: string, labels: {NAMED}, aliases: map<string, array<struct<value: string>>>, descriptions: {NAMED}>>"
PREDICTIONS = "id string, source_language string, target_language string, text string, prediction string"


def json_lines(spark: SparkSession, folder: str, schema: str, recursive: bool = True, pattern: str = "*.jsonl", ordinal: str | None = None) -> DataFrame:
    """All JSON-lines files of a folder; missing fields are null, and there is no schema inference.

    ordinal: name of a further column that orders rows as they stand in the files, and files by path.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).json(folder)
    return rows if ordinal is None else with_ordinal(rows, ordinal)


def with_ordinal(rows: DataFrame, name: str) -> DataFrame:
    """Rows, as they are read from files, with a column that orders them as they stand there: by path, block and place.

    A block of a file is read by one task from its start to its end, so the task's running number orders its rows; tasks
    need not know of one another, and nothing is sorted.  Only for a table that was just read: behind a shuffle, places
    are lost.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(name))


def varied_lines(spark: SparkSession, folder: str, fields: Mapping[str, tuple[str, Sequence[str]]], recursive: bool = True, pattern: str = "*.jsonl", ordinal: str | None = None) -> DataFrame:
    """JSON lines whose fields go by several names: a column for each of ``fields`` (name: type and aliases), and the raw line
    where it is no JSON object, as ``corrupt`` (null otherwise).

    Each line is read once, as a VARIANT.  Of a field's aliases the first counts that has a value of its type which isn't
    an empty text.  An alias may be a path, such as ``$.target.text``.  Blank lines are no rows.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(folder)
    lines = lines if ordinal is None else with_ordinal(lines, ordinal)
    return unified(lines.where(~F.col("value").rlike(r"^\s*$")), "value", fields)


def unified(rows: DataFrame, text: str, fields: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """``rows`` with the fields of a column of JSON texts, as ``varied_lines`` has them, instead of that column."""
    held = rows.withColumn("_v", F.try_parse_json(text)).withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))

    def value(kind: str, aliases: Sequence[str]) -> Column:
        found = [F.try_variant_get("_v", a if a.startswith("$") else f"$['{a}']", kind) for a in aliases]
        return F.coalesce(*[tx.or_null(f) if kind == "string" else f for f in found])

    others = [c for c in rows.columns if c != text]
    return held.select(*others, *[value(*f).alias(n) for n, f in fields.items()], F.when(F.col("_v").isNull(), F.col(text)).alias("corrupt"))


def qid_locale_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Sorted distinct (qid, locale) of both feeds."""
    a = train.select(F.explode("entities").alias("qid"), F.col("target_locale").alias("locale"))
    b = evaluation.select(F.col("wikidata_id").alias("qid"), F.col("target_locale").alias("locale"))
    return a.union(b).where((tx.safe("qid") != "") & (tx.safe("locale") != "")).distinct().orderBy("qid", "locale")


def qid_locales(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of (qid, locale)."""
    return spark.read.schema(QID_LOCALES).option("multiLine", True).json(path)


def train_examples(train: DataFrame, target_lang: str | None = None) -> DataFrame:
    """An example for each entity of each training sentence, named ``id::place``."""
    some = train if target_lang is None else train.where(F.col("target_locale") == target_lang)
    rows = some.select("*", F.posexplode("entities").alias("place", "gold_qid"))
    return rows.select(F.concat_ws("::", "id", "place").alias("example_id"), "source", F.col("target_locale").alias("target_lang"), "gold_qid")


def validation_examples(evaluation: DataFrame, target_lang: str | None = None) -> DataFrame:
    some = evaluation if target_lang is None else evaluation.where(F.col("target_locale") == target_lang)
    return some.select(F.col("id").alias("example_id"), "source", F.col("target_locale").alias("target_lang"), F.col("wikidata_id").alias("gold_qid"))


def references(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(dataset_id, translation_text, mention_text, reference_order): the one of a training sentence is 0."""
    a = train.select(F.col("id").alias("dataset_id"), F.col("target").alias("translation_text"), F.lit(None).cast("string").alias("mention_text"), F.lit(0).alias("reference_order"))
    b = evaluation.select(F.col("id").alias("dataset_id"), F.posexplode("targets").alias("reference_order", "t"))
    return a.unionByName(b.select("dataset_id", F.col("t.translation").alias("translation_text"), F.col("t.mention").alias("mention_text"), "reference_order"))


def example_entities(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(dataset_id, qid, entity_order)."""
    a = train.select(F.col("id").alias("dataset_id"), F.posexplode("entities").alias("entity_order", "qid"))
    b = evaluation.where(tx.safe("wikidata_id") != "").select(F.col("id").alias("dataset_id"), F.lit(0).alias("entity_order"), F.col("wikidata_id").alias("qid"))
    return a.unionByName(b).select("dataset_id", "qid", "entity_order")


def entity_types(evaluation: DataFrame) -> DataFrame:
    """Distinct (qid, type_text)."""
    return evaluation.select(F.col("wikidata_id").alias("qid"), F.explode("entity_types").alias("type_text")).where(tx.safe("qid") != "").distinct()


def entity_terms(documents: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(qid, lang_code, term_type, term_text) of captured entity documents; missing entities are left out."""
    some = documents.select(F.explode("entities").alias("qid", "e")).where("e IS NOT NULL AND e.missing IS NULL")
    label = some.select("qid", F.explode("e.labels").alias("lang_code", "v")).select("qid", "lang_code", F.lit("label").alias("term_type"), F.col("v.value").alias("term_text"))
    alias = some.select("qid", F.explode("e.aliases").alias("lang_code", "vs")).select("qid", "lang_code", F.lit("alias").alias("term_type"), F.explode("vs.value").alias("term_text"))
    described = some.select("qid", F.explode("e.descriptions").alias("lang_code", "v")).select("qid", "lang_code", F.lit("description").alias("term_type"), F.col("v.value").alias("term_text"))
    every = label.unionByName(alias).unionByName(described)
    return every if languages is None else every.where(F.col("lang_code").isin(languages))


def entities(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(qid, popularity_score) of all distinct entities of both feeds, their popularity unknown."""
    every = train.select(F.explode("entities").alias("qid")).union(evaluation.select("wikidata_id")).select(tx.safe("qid").alias("qid"))
    return every.where("qid <> ''").distinct().select("qid", F.lit(None).cast("double").alias("popularity_score"))


def jdbc_options(env: Mapping[str, str]) -> dict[str, str]:
    """Options of a MySQL database from settings DB_HOST, DB_PORT (3306), DB_USER, DB_PASSWORD and DB_NAME."""
    missing = [k for k in ("DB_HOST", "DB_NAME") if not env.get(k)]
    if missing:
        raise ValueError(f"settings lack {', '.join(missing)}")
    given = {"user": env.get("DB_USER"), "password": env.get("DB_PASSWORD")}
    return {"url": f"jdbc:mysql://{env['DB_HOST']}:{int(env.get('DB_PORT') or 3306)}/{env['DB_NAME']}?characterEncoding=UTF-8"} | {k: v for k, v in given.items() if v is not None}


def jdbc(spark: SparkSession, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database; predicates and columns are pushed down by Spark's reader.

    partition: a numeric column, its bounds and into how many parts it is read; without it one task reads the table.
    """
    reader = spark.read.format("jdbc").options(dbtable=name, **options)
    if partition is not None:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def prediction_records(predictions: DataFrame) -> DataFrame:
    """Predictions (id, source_lang, target_lang, text, prediction) as records with locales."""
    source, target = tx.locale_of(F.coalesce(tx.or_null("source_lang"), F.lit("en"))), tx.locale_of("target_lang")
    return predictions.select(F.col("id").cast("string").alias("id"), source.alias("source_language"), target.alias("target_language"), tx.safe("text").alias("text"), tx.safe("prediction").alias("prediction"))


def write_json_lines(rows: DataFrame, folder: str) -> None:
    """A folder of JSON-lines files, characters as they are."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def missing_from(rows: DataFrame, stored: DataFrame, keys: list[str], order: Column | str | None = None) -> DataFrame:
    """Rows, one a key (the first by ``order``, or else the least), whose keys aren't stored yet: what an idempotent append adds.

    For a stored table of any kind, all of whose keys are read; ``sources.keyed`` reads only those that may be there.
    """
    return first_of_keys(rows, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")


def fallback_chain(fallbacks: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """(lang_code, fallback, distance) of every language and all that can stand in for it, itself at distance 0.

    fallbacks: (lang_code, fallback, place): a language's own fallbacks in order.  A language is reached by the fewest
    steps, then by the places on the way; rings end.  The relation is joined with itself, each round one step further,
    until nothing new is reached: as many rounds as the longest way has steps.  languages: only these are started from.
    """
    steps = fallbacks.where((tx.safe("lang_code") != "") & (tx.safe("fallback") != "")).groupBy("lang_code", "fallback").agg(F.min("place").alias("place"))
    every = steps.select("lang_code").union(steps.select("fallback")).distinct()
    every = every if languages is None else every.where(F.col("lang_code").isin(list(languages)))
    way = "array<bigint>"
    reached = every.select("lang_code", F.col("lang_code").alias("fallback"), F.lit(0).alias("distance"), F.array().cast(way).alias("way"))
    last, distance = reached, 0
    while True:
        distance += 1
        step = steps.select(F.col("lang_code").alias("fallback"), F.col("fallback").alias("_next"), F.col("place").cast("bigint").alias("_place"))
        on = last.join(step, "fallback").select("lang_code", F.col("_next").alias("fallback"), F.concat("way", F.array("_place")).alias("way"))
        new = on.groupBy("lang_code", "fallback").agg(F.min("way").alias("way")).join(reached, ["lang_code", "fallback"], "left_anti")
        # Written, as each round's plan would else hold those of all before it.
        held = shared.folder(fallbacks.sparkSession)
        new.select("lang_code", "fallback", F.lit(distance).alias("distance"), "way").write.parquet(held)
        last = fallbacks.sparkSession.read.schema("lang_code string, fallback string, distance int, way array<bigint>").parquet(held)
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    return reached.select("lang_code", "fallback", F.row_number().over(Window.partitionBy("lang_code").orderBy("distance", "way", "fallback")).alias("distance")).withColumn("distance", F.col("distance") - 1)


def terms_with_fallback(terms: DataFrame, chain: DataFrame) -> DataFrame:
    """(qid, lang_code, term_type, term_text, from_lang): for each entity, language of a chain and kind of term those of the
    nearest language that has any."""
    near = terms.withColumnRenamed("lang_code", "fallback").join(F.broadcast(chain), "fallback")
    least = near.groupBy("qid", "lang_code", "term_type").agg(F.min("distance").alias("distance"))
    return near.join(least, ["qid", "lang_code", "term_type", "distance"]).select("qid", "lang_code", "term_type", "term_text", F.col("fallback").alias("from_lang"))
