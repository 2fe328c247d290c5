"""Examples with their references and entities, and the knowledge base, from relational tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.sources import shared


def filtered(table: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns equal what is given; None asks nothing of a column."""
    for name, value in equal.items():
        if value is not None:
            table = table.where(F.col(name) == value)
    return table


def keep_last(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of equal keys the last one."""
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ordered_list(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: values in the order of other columns, then their own."""
    keys = [tx.col(o).alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.sort_array(F.collect_list(F.struct(*keys, tx.col(value).alias("v")))), lambda x: x["v"])


def first_by(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: the value of the lowest order, among those that aren't empty."""
    v = tx.or_null(value)
    return F.min(F.when(v.isNotNull(), F.struct(*[tx.col(o).alias(f"k{i}") for i, o in enumerate(order)], v.alias("v"))))["v"]


@dataclass
class Tables:
    """Examples (example_id, split, source_locale, target_locale, source), references, entities, types and terms."""

    examples: DataFrame
    references: DataFrame
    entities: DataFrame
    types: DataFrame
    terms: DataFrame


def load(tables: Tables, split: str | None = None, target_locale: str | None = None, source_locale: str | None = None, limit: int | None = None, require_references: bool = True, require_mentions: bool = True) -> DataFrame:
    """Assembled examples of a split and locales; limit: the first so many by example_id.

    References and entities are read for these examples only, and terms for their entities.
    """
    some = filtered(tables.examples, split=split, target_locale=target_locale, source_locale=source_locale)
    if limit is not None:
        some = some.orderBy("example_id").limit(limit)
    if limit is not None or split is not None or target_locale is not None or source_locale is not None:
        ids = some.select("example_id")
        references, entities = (t.join(ids, "example_id", "left_semi") for t in (tables.references, tables.entities))
        terms = tables.terms.join(entities.select("qid"), "qid", "left_semi")
    else:
        references, entities, terms = tables.references, tables.entities, tables.terms
    return assembled(some, references, entities, tables.types, terms, require_references, require_mentions)


def with_example_ids(rows: DataFrame, examples: DataFrame, order: str = "example_id") -> DataFrame:
    """Rows (dataset_id, ...) with the example_id of their dataset_id, the last of several; rows without one are left out."""
    ids = keep_last(examples.select("dataset_id", F.col("example_id"), F.col(order).alias("_order")), ["dataset_id"], "_order").drop("_order")
    return rows.join(ids, "dataset_id")


def assembled(examples: DataFrame, references: DataFrame, entities: DataFrame, types: DataFrame, terms: DataFrame, require_references: bool = True, require_mentions: bool = True) -> DataFrame:
    """Examples with target, targets, gold_qid, qids, types, and mentions recovered from terms in the target language.

    References without a translation are left out.  Examples that miss what is required raise an error that tells how
    many and names up to five, in one run for all that is required; ``save`` finds that out in the run that writes them.
    """
    refs = references.where(tx.safe("translation_text") != "")
    qids = entities.join(types.groupBy("qid").agg(F.sort_array(F.collect_set("type_text")).alias("types")), "qid", "left")
    per_qid = qids.groupBy("example_id").agg(
        ordered_list("qid", "entity_order").alias("qids"), F.array_distinct(F.flatten(ordered_list(F.coalesce("types", F.array().cast("array<string>")), "entity_order"))).alias("entity_types")
    )
    named = terms.where(F.col("term_type").isin("label", "alias")).select("qid", "lang_code", "term_text", F.when(F.col("term_type") == "label", 0).otherwise(1).alias("first"), "term_id")
    found = entities.join(examples.select("example_id", F.col("target_locale").alias("lang_code")), "example_id").join(named, ["qid", "lang_code"])
    recovered = found.groupBy("example_id").agg(tx.ordered_distinct(ordered_list("term_text", "entity_order", "first", "term_id")).alias("recovered"))
    targets = refs.join(recovered, "example_id", "left").select("example_id", "reference_order", "reference_id", _target().alias("t")).groupBy("example_id").agg(ordered_list("t", "reference_order", "reference_id").alias("targets"))
    out = examples.join(targets, "example_id", "left").join(per_qid, "example_id", "left")
    out = out.select(
        *examples.columns, F.get("targets", 0)["translation"].alias("target"), "targets", F.get("qids", 0).alias("gold_qid"),
        F.coalesce("qids", F.array().cast("array<string>")).alias("entity_qids"), F.coalesce("entity_types", F.array().cast("array<string>")).alias("entity_types"),
    )
    required = [n for n, asked in (("a reference", require_references), ("a mention", require_mentions)) if asked]
    if required:
        _raised(out.agg(*_lacks(required)).first().asDict())
    return out


def save(examples: DataFrame, path: str, require_references: bool = True, require_mentions: bool = True) -> None:
    """Writes assembled examples (not yet held against what is required) to a new folder, in one run.

    What they lack is observed while they are written; if they do, an error tells how many and names five, and nothing is
    left.  The folder gets its name once all is written and nothing is lacking.
    """
    spark, beside = examples.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    required = [n for n, asked in (("a reference", require_references), ("a mention", require_mentions)) if asked]
    seen = Observation()
    (examples.observe(seen, *_lacks(required)) if required else examples).write.parquet(beside)
    try:
        if required:
            _raised(seen.get)
        shared.rename(spark, beside, path)
    except BaseException:
        shared.delete(spark, beside)
        raise


def _target() -> Column:
    own, recovered = tx.or_null("mention_text"), F.coalesce("recovered", F.array().cast("array<string>"))
    names = tx.ordered_distinct(F.concat(F.array(own), recovered))
    return F.struct(tx.safe("translation_text").alias("translation"), F.coalesce(own, F.get(recovered, 0)).alias("mention"), names.alias("mention_candidates"))


#: What an example of some requirement holds, and into how many groups by hash examples that lack it are dealt; the least of each group is named.
_HOLDS = {"a reference": lambda: F.size("targets") > 0, "a mention": lambda: F.exists("targets", lambda t: F.size(t["mention_candidates"]) > 0)}
_NAMED = 5


def _lacks(required: list[str]) -> list[Column]:
    """Aggregates of bounded size: for each requirement the number of examples that lack it, and five of these."""
    out = []
    for i, name in enumerate(required):
        lacks = ~F.coalesce(_HOLDS[name](), F.lit(False))
        group = F.pmod(F.xxhash64("example_id"), F.lit(_NAMED))
        least = [F.min(F.when(lacks & (group == g), F.col("example_id"))) for g in range(_NAMED)]
        out += [F.count_if(lacks).alias(f"n{i}_{name}"), F.array_sort(F.array_compact(F.array(*least))).alias(f"ids{i}_{name}")]
    return out


def _raised(found: dict) -> None:
    """Raises an error of the first requirement that examples lack."""
    for key, n in found.items():
        if key.startswith("n") and n:
            place, _, name = key[1:].partition("_")
            raise ValueError(f"{n} examples lack {name}, such as {', '.join(map(str, found[f'ids{place}_{name}']))}")


def knowledge_base(entity: DataFrame, terms: DataFrame, types: DataFrame, target_lang: str) -> DataFrame:
    """A row for each entity in one language: labels, aliases, description, type and surfaces (see ``operators.retrieval``).

    Only terms of that language and English are read.  Descriptions fall back on English; the first type by name counts.
    """
    some = terms.where(F.col("lang_code").isin("en", target_lang))

    def texts(lang: str, kind: str) -> Column:
        mine = (F.col("lang_code") == lang) & (F.col("term_type") == kind)
        return F.transform(F.sort_array(F.collect_list(F.when(mine & (tx.safe("term_text") != ""), F.struct("term_id", tx.safe("term_text").alias("v"))))), lambda x: x["v"])

    wide = some.groupBy("qid").agg(
        texts("en", "label").alias("en_label"), texts("en", "alias").alias("en_alias"), texts("en", "description").alias("en_text"),
        texts(target_lang, "label").alias("to_label"), texts(target_lang, "alias").alias("to_alias"), texts(target_lang, "description").alias("to_text"),
    )
    one_type = types.groupBy("qid").agg(F.min(tx.or_null("type_text")).alias("entity_type"))
    rows = entity.join(wide, "qid", "left").join(one_type, "qid", "left")
    none = F.array().cast("array<string>")
    surfaces = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("en_label", none), F.coalesce("en_alias", none)), tx.normalize_surface), lambda s: s != ""))
    return rows.select(
        "qid", F.lit(target_lang).alias("target_lang"), F.get("en_label", 0).alias("label_en"), F.coalesce("en_alias", none).alias("aliases_en"), F.get("to_label", 0).alias("target_label"),
        F.coalesce("to_alias", none).alias("target_aliases"), "entity_type", F.coalesce(F.get("to_text", 0), F.get("en_text", 0)).alias("description"),
        F.coalesce(F.size("to_label") > 0, F.lit(False)).alias("language_available"), tx.non_negative("popularity_score").alias("popularity"), surfaces.alias("surfaces"),
    )
