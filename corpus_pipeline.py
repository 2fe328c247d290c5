"""From raw documents to shards: five stages, each of which takes and returns documents.

Each stage is one operator of ``lexweave.llm`` at its production parameters.  ``run`` writes every stage's rows to the
shared folder as Parquet and reads them again for the next; what a stage wrote besides is
deleted then.  All stages but the last return the columns of documents, whatever these are called.

Mixing takes a document as often as its rate says, so the last two stages' rows may repeat ids.  Rows without an id, or
with null or empty texts, don't pass the quality rules; the other stages keep them where they meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import Held, quoted, scratch, table
from lexweave.llm.decontamination import decontaminate
from lexweave.llm.mixing import TARGETS, domain_of_labels, mixed
from lexweave.llm.near_copies import near_copy_components
from lexweave.llm.quality import quality_verdicts
from lexweave.llm.sharding import shard_records

SHARDS = 16
#: A document is taken so often at most: up to four passes over a text are about as good for training as new text.  And
#: the weight of the rates' distance from 1: the mix misses its targets rather than leave many good documents out.
MOST_COPIES, KEEPING = 4.0, 0.05


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    held, labels = Held(docs, "doc_id", "text"), table(spark, sf_dir, "labels")
    return held.back(quality_verdicts(held.rows, labels.select(F.col("doc_id").alias("k"), "quality"), text="t", key="k").where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Rows are told apart by id and text (by 64 bits of their hash), so unlike texts of one id, as sources that are joined may
    have, all stay.  Of equal rows one stays; rows without an id all stay.
    """
    held = Held(docs, "doc_id", "text")
    rows = held.rows.withColumn("row", F.xxhash64("k", "t"))
    named = rows.where("k IS NOT NULL")
    found = near_copy_components(named, "row", "t").select("row", "component_id").distinct()
    ids = named.select("row", "k").distinct()
    least = ids.join(found.hint("merge"), "row").groupBy("component_id").agg(F.min(F.struct("k", "row"))["row"].alias("row")).select("row")
    first = Window.partitionBy("row").orderBy("k")
    stay = named.join(least.hint("merge"), "row", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return held.back(stay.drop("nth").unionByName(rows.where("k IS NULL")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their spans of test items, and none that mostly consist of such."""
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*[quoted(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    The quality rules leave little of the poor domain, so good text is kept whole, and the other domains come as near to
    their targets beside it as that allows.  The classifier is fitted on labelled texts of the whole table.
    """
    held, labels = Held(docs, "doc_id", "text"), domain_of_labels(table(spark, sf_dir, "labels"))
    labelled = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    rated = mixed(held.rows, labels.withColumnRenamed("doc_id", "k"), TARGETS, key="k", text="t", most=MOST_COPIES, whole="good", ridge=KEEPING, fit_on=labelled).where("copies > 0")
    return held.back(rated.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards."""
    return shard_records(docs, ["doc_id"], [(s, 1.0) for s in range(SHARDS)])


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("mixing to target weights", mixing), ("sharding", sharding)]

#: Hashes, a fitted classifier and fitted rates have no DuckDB counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
