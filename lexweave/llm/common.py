"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class of the six ASCII white space characters that part words.
SPACE = r"[\x20\x09-\x0D]"
#: Folders that ``cut`` has written and that weren't deleted yet, oldest first.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary one is set if all of Spark runs on this machine; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lexweave"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession, since: int = 0, keep: Sequence[str] = ()) -> None:
    """Deletes what ``cut`` has written, from the ``since``-th folder on, but for those in ``keep``.

    Only for when all that was derived from them has been written or read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _written[since:] if p not in keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose intermediate tables are deleted at its end; what goes through the function it gives is cut and stays."""
    since, keep = len(_written), []

    def kept(df: DataFrame) -> DataFrame:
        out = cut(df)
        keep.append(_written[-1])
        return out

    try:
        yield kept
    finally:
        swept(spark, since, keep)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Held:
    """Rows whose key and text have names of our own, and whose other columns lie in a structure, so that none can clash.

    ``rows`` has the columns k (if there is a key), t and rest; ``back`` makes the caller's columns of them again.
    """

    def __init__(self, docs: DataFrame, key: str | None, text: str):
        self.columns, self.key, self.text = docs.columns, key, text
        self.others = [c for c in docs.columns if c not in (key, text)]
        rest = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(self.others)]) if self.others else F.lit(None).cast("boolean")
        named = [F.col(quoted(key)).alias("k")] if key is not None else []
        self.rows = docs.select(*named, F.col(quoted(text)).alias("t"), rest.alias("rest"))

    def back(self, df: DataFrame, new: Sequence[str] = ()) -> DataFrame:
        """The caller's columns, but for those named like ``new`` ones, then the new ones.  Without t in ``df`` there is no text."""
        own = {self.key: F.col("k"), self.text: F.col("t")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(self.others)}
        taken = {n.lower() for n in new}
        names = [c for c in self.columns if c.lower() not in taken and (c != self.text or "t" in df.columns)]
        return df.select(*[own[c].alias(c) for c in names], *[F.col(n) for n in new])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null.

    Most texts part their words by single blanks and line feeds, for which splitting at one character is enough.
    """
    t = F.replace(F.btrim(F.coalesce(text, F.lit("")), F.lit("\t\n\x0b\f\r ")), F.lit("\n"), F.lit(" "))
    some = let(t, lambda x: F.when(x == "", F.array().cast("array<string>")).when(x.rlike("[\\x09-\\x0D]|  "), F.split(x, SPACE + "+")).otherwise(F.split(x, " ")))
    return some
