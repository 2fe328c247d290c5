"""Files on the file system that driver and executors share, whatever it is: bytes, folders and renames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``, which is set to a temporary one only where all of Spark runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lexweave/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the files and folders in a folder; none if it isn't there."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Gives a file or folder another name, which nothing may have yet."""
    (a, fs), (b, _) = _at(spark, old), _at(spark, new)
    if b.getParent() is not None:
        fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(new)


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """A file of a new name: written beside it and renamed, so that it is whole as soon as it is there."""
    beside = f"{path}.{uuid.uuid4().hex}.part"
    at, fs = _at(spark, beside)
    out = fs.create(at, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    try:
        rename(spark, beside, path)
    except FileExistsError:
        delete(spark, beside)
        raise


def read_bytes(spark: SparkSession, path: str) -> bytes:
    at, fs = _at(spark, path)
    opened = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(opened))
    finally:
        opened.close()


def joined(spark: SparkSession, parts: list[str], path: str, before: bytes = b"", after: bytes = b"", skip: int = 0) -> None:
    """One file of several, in order, between two texts, without the first ``skip`` bytes; bytes stream from file to file, and none are held."""
    at, fs = _at(spark, path)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(at, True)
    try:
        out.write(bytearray(before))
        for p in parts:
            one, own = _at(spark, p)
            opened = own.open(one)
            try:
                while skip and opened.read() >= 0:
                    skip -= 1
                copy(opened, out, 1 << 16, False)
            finally:
                opened.close()
        out.write(bytearray(after))
    finally:
        out.close()
