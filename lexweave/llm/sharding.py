"""Rendezvous hashing of stable record keys over weighted shards.

Each record draws, for each shard, a score from a hash of its key and the shard's name, and goes to the shard with the
highest.  A shard's score doesn't depend on the other shards, so adding one moves records only into it, and removing
one moves only its own records.  Scores are ``-weight / ln(u)`` with ``u`` uniform in (0, 1), which gives each shard a
share in proportion to its weight.

All of it is column expressions: no shuffle for the assignment, and for slot numbers shuffles of keys (no texts).

Defined cases: a null key is a key like any other; a null or empty text has size 1; repeated rows get the same shard
and slots of their own; an empty table gives an empty table; further columns are kept, and a column named like a new
one is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import cut, quoted, table

#: Slot numbers are counted within buckets of about so many rows, and a shard's buckets laid end to end.
SLOT_ROWS = 50_000
#: Repeated rows are written out from their count in runs of this many.
RUN = 100_000


def rendezvous(keys: Sequence[Column], shards: Sequence[tuple[int, float]]) -> Column:
    """Shard of a record: ``shards`` are (name, weight > 0); ties, which need equal 52-bit draws, go to the larger name."""
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("there must be shards, with weights above 0")

    def score(name: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(int(name))), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(int(name)).alias("shard"))

    return F.array_max(F.array(*[score(*s) for s in shards])).getField("shard")


def shard_records(docs: DataFrame, keys: Sequence[str], shards: Sequence[tuple[int, float]], out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row, without a shuffle."""
    return docs.withColumn(out, rendezvous([F.col(k) for k in keys], shards))


def number_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """``rows`` with a number in each shard, gapless from 0; columns need an order, so maps are no part of them.

    Equal rows are counted first, which also folds hot keys before the shuffle; the counts are written to the shared
    folder once.  They are numbered as runs within a bucket of their shard, of which there are as many as the number of
    rows asks for, and written out again from their count.
    """
    at = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    counted = cut(rows.select(*[F.col(quoted(c)).alias(a) for c, a in at.items()]).groupBy(*at.values()).agg(F.count(F.lit(1)).alias("n")))
    most = counted.groupBy(at[shard]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    buckets = -(-most // SLOT_ROWS)
    named = counted.withColumn("s", F.col(at[shard])).withColumn("b", F.pmod(F.xxhash64(*[F.col(at[c]) for c in order]), F.lit(buckets)))
    ends = named.groupBy("s", "b").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("s").alias("s_"), F.col("b").alias("b_"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("s", "b").orderBy(*[at[c] for c in order], *[a for c, a in at.items() if c not in order]).rowsBetween(Window.unboundedPreceding, -1)
    # starts has a row for each SLOT_ROWS rows of the largest shard, and shard; Spark broadcasts it if that is small.
    numbered = named.withColumn("at", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(starts, F.col("s").eqNullSafe(F.col("s_")) & (F.col("b") == F.col("b_")))
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))))
    last = F.least(F.col("n") - 1, (F.col("run") + 1) * RUN - 1)
    out = runs.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, last)))
    names = [c for c in rows.columns if c.lower() != slot.lower()]
    return out.select(*[F.col(at[c]).alias(c) for c in names], (F.col("start") + F.col("at") + F.col("i")).alias(slot))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = shard_records(rows, ["doc_id"], [(s, 1.0) for s in range(shards)])
    rows = shard_records(rows, ["doc_id"], [(s, 1.0) for s in range(shards + 1)], out="grown_shard")
    out = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("bigint"), F.col("grown_shard").cast("int"))
