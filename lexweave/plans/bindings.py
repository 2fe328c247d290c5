"""The logical tables (examples, knowledge base, and so on) over the TPC-H-like and document tables of the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.sources.dataset import ordered_list

LANGS = ("en", "de", "fr", "es")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("source"), F.col("lang").alias("target_lang"), F.lit(None).cast("string").alias("gold_qid"))


def benchmark_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items as entities of every language, their 3- to 5-grams as surfaces."""
    none = F.array().cast("array<string>")
    rows = read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("qid"), F.explode(F.array(*[F.lit(x) for x in LANGS])).alias("target_lang"), F.col("text").alias("label_en"), none.alias("aliases_en"),
        F.col("text").alias("target_label"), none.alias("target_aliases"), F.lit("item").alias("entity_type"), F.lit(None).cast("string").alias("description"),
        F.lit(True).alias("language_available"), F.lit(0.0).alias("popularity"), tx.ngrams(tx.tokens(tx.normalize_surface("text")), 3, 5).alias("surfaces"),
    )
    return rows


def order_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example for each order: its parts' names as the source, its first part as the gold entity."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = lines.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    whole = named.groupBy(F.col("l_orderkey").alias("example_id")).agg(F.array_join(ordered_list("p_name", "l_linenumber", "l_partkey"), " ").alias("source"), F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first"))
    return whole.select("example_id", "source", F.lit("en").alias("target_lang"), F.concat(F.lit("P"), "first").alias("gold_qid"))


def part_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities that share names; those of size 10 or more are usable."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P"), "p_partkey").alias("qid"), F.lit("en").alias("target_lang"), F.col("p_name").alias("label_en"), F.array().cast("array<string>").alias("aliases_en"),
        F.col("p_name").alias("target_label"), F.array("p_brand").alias("target_aliases"), F.col("p_type").alias("entity_type"), F.concat_ws(" ", "p_type", "p_name").alias("description"),
        (F.col("p_size") >= 10).alias("language_available"), F.col("p_retailprice").alias("popularity"), F.array(tx.normalize_surface("p_name")).alias("surfaces"),
    )


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of parts: names as labels (English ones of all, French ones of the larger), brands as aliases, types as descriptions."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("qid"), "p_partkey", "p_name", "p_brand", "p_type", "p_size")

    def terms(rows: DataFrame, lang: str, kind: str, column: str, nth: int) -> DataFrame:
        return rows.select((F.col("p_partkey") * 4 + nth).alias("term_id"), "qid", F.lit(lang).alias("lang_code"), F.lit(kind).alias("term_type"), F.col(column).alias("term_text"))

    return (
        terms(p, "en", "label", "p_name", 0).unionByName(terms(p, "en", "alias", "p_brand", 1)).unionByName(terms(p, "en", "description", "p_type", 2))
        .unionByName(terms(p.where("p_size >= 10"), "fr", "label", "p_name", 3))
    )
