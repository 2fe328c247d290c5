"""Slots for models that aren't part of the engine: text generation and translation scoring, in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Generate = Callable[[list[str]], list[str]]
Score = Callable[[list[str], list[str], list[str]], list[float]]


def generate_halving(generate: Generate, prompts: Sequence[str]) -> list[str]:
    """Generates for all prompts; where memory runs out it goes on with halves, down to single prompts."""
    prompts = list(prompts)
    try:
        return list(generate(prompts))
    except MemoryError:
        if len(prompts) < 2:
            raise
        half = len(prompts) // 2
        return generate_halving(generate, prompts[:half]) + generate_halving(generate, prompts[half:])


#: What a Python worker has loaded, by the name that a frame gave it: workers stay from task to task.
_loaded: dict[str, object] = {}


def loaded(name: str, make: Callable[[], object]) -> object:
    """What ``make`` makes, once a worker for each name; another name's is let go first, so that one model is held at a time."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = make()
    return _loaded[name]


def generated_frame(rows: DataFrame, prompt: str, out: str, make: Callable[[], Generate], batch: int = 8) -> DataFrame:
    """``rows`` with generated texts; ``make`` loads the model once a worker."""
    name = uuid.uuid4().hex
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def run(frames: Iterator) -> Iterator:
        generate = loaded(name, make)
        for frame in frames:
            texts: list[str] = []
            for at in range(0, len(frame), batch):
                texts += generate_halving(generate, frame[prompt].iloc[at : at + batch].tolist())
            frame[out] = texts
            yield frame[[f.name for f in schema.fields]]

    return rows.mapInPandas(run, schema)


def scored_frame(rows: DataFrame, score: Score | None = None, columns: tuple[str, str, str] = ("source", "reference", "prediction"), out: str = "score", make: Callable[[], Score] | None = None, batch: int | None = None) -> DataFrame:
    """``rows`` with a score of (source, reference, prediction), in Arrow batches or ``batch`` rows at a time.

    score: a function that is ready; or ``make``, which loads one once a worker.
    """
    if (score is None) == (make is None):
        raise ValueError("there must be a function that scores, or one that makes it")
    schema, name = T.StructType([*[f for f in rows.schema.fields if f.name != out], T.StructField(out, T.DoubleType())]), uuid.uuid4().hex

    def run(frames: Iterator) -> Iterator:
        own = score if make is None else loaded(name, make)
        for frame in frames:
            found: list[float] = []
            step = batch or max(1, len(frame))
            for at in range(0, len(frame), step):
                found += own(*[frame[c].iloc[at : at + step].tolist() for c in columns])
            frame[out] = found
            yield frame[[f.name for f in schema.fields]]

    return rows.mapInPandas(run, schema)
