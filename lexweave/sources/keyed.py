"""Tables that keep one row a key: appends read only the buckets of keys that may be there already.

A table lies in folders by bucket of its rows' key hash, and below by run and batch of the append that wrote them.  Beside
the rows each append writes a filter for each of its buckets: a table of bits of the keys' hashes, ``BITS`` a key and
``LONGS`` numbers at least.  An append reads the filters of its own buckets first.  Keys that no filter holds are new, and
only buckets with other keys are read, by a list of folders that the plan shows as partition filters, and only their
key columns; an append whose keys are all new reads no stored row at all.

Which of equal keys stays doesn't depend on partitions: the first by ``order``, such as an input order (see
``files.json_lines``), and of rows equal in that, or without one, the least by all columns.  An append that is tried again
writes its own folders anew and is held against all others, so it may stop at any point.  A table takes one append at a
time; rows of null keys are rows of a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import shared

BITS, LONGS = 16, 64
_PLACE = ("key_bucket", "ingest_run", "ingest_batch")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def first_of_keys(rows: DataFrame, keys: Sequence[str], order: Column | str | None = None) -> DataFrame:
    """One row a key: the first by ``order``, and of several such the least by all columns (in the order of JSON texts, which any column has)."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    by = ([F.col(order) if isinstance(order, str) else order] if order is not None else []) + [F.to_json(F.struct(*[quoted(c) for c in others]))]
    picked = F.min_by(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)]), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)]))
    out = rows.groupBy(*[quoted(k) for k in keys]).agg(picked.alias("_r"))
    place = {c: f"_r.c{i}" for i, c in enumerate(others)}
    return out.select(*[F.col(place.get(c, quoted(c))).alias(c) for c in rows.columns])


@dataclass
class KeyedTable:
    """A table at ``path`` with one row a key; ``buckets`` must stay the same as long as the table is."""

    path: str
    keys: Sequence[str]
    buckets: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[quoted(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _hash(self) -> Column:
        return F.xxhash64(*[quoted(k) for k in self.keys], F.lit(1))

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """All stored rows, with the columns of their place."""
        return spark.read.schema(f"{schema}, key_bucket int, ingest_run string, ingest_batch bigint").parquet(f"{self.path}/rows")

    def _filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("bits array<bigint>, key_bucket int, ingest_run string, ingest_batch bigint").parquet(f"{self.path}/filters")

    def missing(self, rows: DataFrame, run: str | None = None, batch: int | None = None) -> DataFrame:
        """Of rows of distinct keys those whose keys aren't stored yet, but by the append of that run and number."""
        spark = rows.sparkSession
        if not shared.exists(spark, f"{self.path}/rows"):
            return rows
        others = ~((F.col("ingest_run") == F.lit(run)) & (F.col("ingest_batch") == F.lit(batch))) if run is not None else F.lit(True)
        mine = rows.withColumn("key_bucket", self.bucket()).withColumn("_hash", self._hash())
        asked = sorted(r[0] for r in mine.select("key_bucket").distinct().collect())
        if not asked:
            return rows
        filters = self._filters(spark).where(F.col("key_bucket").isin(asked) & others).select("key_bucket", "bits")
        # A key may be stored if it is in any of its bucket's filters; each has a size of its own.
        told = mine.select("key_bucket", "_hash").join(filters, "key_bucket").where(_held(F.col("bits"), F.col("_hash"))).select("key_bucket", "_hash").distinct()
        read = sorted(r[0] for r in told.select("key_bucket").distinct().collect())
        if not read:
            return rows
        stored = self.rows(spark, _ddl(rows)).where(F.col("key_bucket").isin(read) & others).select(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        same = [F.col(quoted(k)).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return rows.join(stored, same, "left_anti")

    def append(self, rows: DataFrame, run: str, batch: int, order: Column | str | None = None) -> None:
        """Adds the rows of keys that aren't there yet; what the same run and number wrote before is replaced.

        The filters go first: a key that a filter has and no row is only looked for in vain, the other way round it would be doubled.
        """
        spark = rows.sparkSession
        new = self.missing(first_of_keys(rows, self.keys, order), run, batch)
        if order is not None and isinstance(order, str):
            new = new.drop(order)
        held = shared.folder(spark)
        new.withColumn("key_bucket", self.bucket()).withColumn("ingest_run", F.lit(run)).withColumn("ingest_batch", F.lit(batch).cast("bigint")).write.partitionBy(*_PLACE).parquet(held)
        written = spark.read.schema(f"{_ddl(new)}, key_bucket int, ingest_run string, ingest_batch bigint").parquet(held)
        for kind in ("filters", "rows"):
            for old in self._own(spark, kind, run, batch):
                shared.delete(spark, old)
        # A filter is as long as its bucket's number of new keys asks for.
        sized = written.select("key_bucket", self._hash().alias("h")).join(written.groupBy("key_bucket").agg(F.greatest(F.lit(LONGS), F.ceil(F.count(F.lit(1)) * BITS / 64)).alias("n")), "key_bucket")
        places = sized.select("key_bucket", "n", F.explode(F.array(*_places(F.col("h"), F.col("n")))).alias("p"))
        numbers = places.groupBy("key_bucket", "n", F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("b"))
        filled = numbers.groupBy("key_bucket", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "b"))).alias("m"))
        bits = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
        filters = filled.select(bits.alias("bits"), "key_bucket", F.lit(run).alias("ingest_run"), F.lit(batch).cast("bigint").alias("ingest_batch"))
        filters.write.mode("append").partitionBy(*_PLACE).parquet(f"{self.path}/filters")
        # Each bucket's folder takes its place whole.
        for b in shared.names(spark, held):
            if b.startswith("key_bucket="):
                shared.rename(spark, f"{held}/{b}/ingest_run={run}/ingest_batch={batch}", f"{self.path}/rows/{b}/ingest_run={run}/ingest_batch={batch}")
        shared.delete(spark, held)

    def _own(self, spark: SparkSession, kind: str, run: str, batch: int) -> list[str]:
        buckets = [b for b in shared.names(spark, f"{self.path}/{kind}") if b.startswith("key_bucket=")]
        paths = [f"{self.path}/{kind}/{b}/ingest_run={run}/ingest_batch={batch}" for b in buckets]
        return [p for p in paths if shared.exists(spark, p)]


def _places(h: Column, longs: Column) -> list[Column]:
    """Places of a hash's two bits in a filter of so many numbers."""
    return [F.pmod(h, longs * 64), F.pmod(F.shiftrightunsigned(h, 32), longs * 64)]


def _held(bits: Column, h: Column) -> Column:
    one, other = (F.call_function("getbit", F.get(bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _places(h, F.size(bits).cast("bigint")))
    return one & other


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields)
