"""Summaries and metrics of runs: small JSON files beside the data, on any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import shared


def metrics_path(explicit: str | None, predictions: str | None, folder: str | None) -> str:
    """Where metrics go: to a path that is given, or beside the predictions, or into a folder."""
    if explicit:
        return explicit
    if predictions:
        head, _, name = predictions.rstrip("/").rpartition("/")
        stem = name.rsplit(".", 1)[0] if "." in name else name
        return f"{head}/{stem}_metrics.json" if head else f"{stem}_metrics.json"
    if folder:
        return f"{folder.rstrip('/')}/metrics.json"
    raise ValueError("there must be a path, predictions or a folder")


def write_json(spark: SparkSession, value: dict | list, path: str) -> None:
    """A JSON file, characters as they are; what was there is replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict | list:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_metrics(metrics: DataFrame, path: str, **more: object) -> dict:
    """The one row of metrics as a JSON file, with further values; gives them back."""
    value = metrics.first().asDict() | more
    write_json(metrics.sparkSession, value, path)
    return value


def overlaid(given: dict, defaults: dict, summary: dict) -> dict:
    """Settings: those of a run's summary, where they are missing defaults, and above all those that were given."""
    return defaults | {k: v for k, v in summary.items() if k in defaults and v is not None} | {k: v for k, v in given.items() if v is not None}


def write_json_array(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array of objects in one file, in their order; characters as they are.

    Each partition writes its lines; the parts' bytes are then streamed into the file, one after the other.  Parts are
    named in the order of partitions, so sorted rows stay sorted.
    """
    spark, held = rows.sparkSession, shared.folder(rows.sparkSession)
    rows.select(F.concat(F.lit(","), F.to_json(F.struct("*"))).alias("value")).write.option("compression", "none").text(held)
    parts = sorted((n for n in shared.names(spark, held) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
    # The comma before the first row goes.
    shared.joined(spark, [f"{held}/{n}" for n in parts], path, b"[\n", b"]\n", skip=1)
    shared.delete(spark, held)
