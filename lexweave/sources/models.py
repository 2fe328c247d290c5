"""A store of models: one file a version, on any file system that Spark reaches.

A file holds named arrays and a few plain values, as NumPy's zip of arrays.  It is written under another name and
renamed, so a version that is there is whole, and versions are never overwritten.  Parameters that were saved by a wrapped
module, whose names begin with ``module.``, are read under their plain names.
"""

from __future__ import annotations

import io
import json
import re

import numpy as np
from pyspark.sql import SparkSession

from lexweave.sources import shared

_VERSION = re.compile(r"version-(\d{6,})\.npz")


def save(spark: SparkSession, folder: str, version: int, arrays: dict[str, np.ndarray], **values: object) -> str:
    """Writes a version, which must be new; gives its path."""
    held = io.BytesIO()
    np.savez(held, **arrays, _values=np.frombuffer(json.dumps(values).encode(), np.uint8))
    path = f"{folder.rstrip('/')}/version-{version:06d}.npz"
    shared.write_bytes(spark, held.getvalue(), path)
    return path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions that are there, in order."""
    return sorted(int(m[1]) for m in map(_VERSION.fullmatch, shared.names(spark, folder)) if m)


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and values of a version, or else of the last."""
    if version is None:
        found = versions(spark, folder)
        if not found:
            raise FileNotFoundError(f"no version in {folder}")
        version = found[-1]
    with np.load(io.BytesIO(shared.read_bytes(spark, f"{folder.rstrip('/')}/version-{version:06d}.npz"))) as f:
        arrays = {n.removeprefix("module."): f[n] for n in f.files if n != "_values"}
        return arrays, json.loads(f["_values"].tobytes().decode()) if "_values" in f.files else {}
