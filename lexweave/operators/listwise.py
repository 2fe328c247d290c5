"""Distributed listwise training of a scorer: AdamW whose gradients are summed where the groups are.

Groups (example_id, numeric_features, labels) are written to the shared folder once, dealt into ``steps`` batches by a hash
of their id, each a folder of its own.  A step reads its batch alone: each partition sums its groups' gradients, batch by
Arrow batch, into one row; these rows are added up in groups of ``FAN`` by a shuffle and then on the driver, which holds
the parameters and makes the step.  No group ever comes to the driver, and all of them are used in each epoch, the batches
in another order each time.  What is dropped out depends on the group's id and the epoch alone, so a task that runs again
gives the same sums.

With a store, each epoch's parameters, moments and history are a version of it; training that was stopped goes on after
the last one, and the best epoch by top-1 accuracy can be loaded.

Defined cases: a group without a candidate of label 1 counts for nothing, nor does one without features or labels; of
several the first is the gold one; null features are 0; without any group the parameters stay as they began.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.rerank import ListwiseScorer
from lexweave.sources import models, shared

#: Rows of summed gradients that one task adds up, and candidates whose hidden units are computed at once: few enough that
#: these stay in a core's cache, and that matrix products take no threads besides the task's own.
FAN, BLOCK = 64, 160
_SUMS = "part bigint, n bigint, loss double, hits bigint, gradient binary"
NAMES = ("w1", "b1", "w2", "b2")


@dataclass
class State:
    """Parameters, AdamW's moments and step, epochs done, and what each epoch gave."""

    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int = 0
    epoch: int = 0
    history: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, model: ListwiseScorer) -> State:
        params = [model.w1.copy(), model.b1.copy(), model.w2.copy(), np.array([float(model.b2)])]
        return cls(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    @property
    def scorer(self) -> ListwiseScorer:
        return ListwiseScorer(*[p.copy() for p in self.params[:3]], float(self.params[3][0]))

    def adamw(self, gradients: Sequence[np.ndarray], rate: float, decay: float) -> None:
        self.step += 1
        for k, p in enumerate(self.params):
            self.first[k] = 0.9 * self.first[k] + 0.1 * gradients[k]
            self.second[k] = 0.999 * self.second[k] + 0.001 * gradients[k] ** 2
            p -= rate * (self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8) + decay * p)

    def best(self) -> int | None:
        """The first epoch (from 1) of the best top-1 accuracy."""
        known = [(-h["top1"], i) for i, h in enumerate(self.history, 1) if h["top1"] is not None]
        return min(known)[1] if known else None

    def save(self, spark: SparkSession, store: str) -> None:
        arrays = {f"{kind}{n}": v for kind, values in (("", self.params), ("first_", self.first), ("second_", self.second)) for n, v in zip(NAMES, values)}
        models.save(spark, store, self.epoch, arrays, step=self.step, epoch=self.epoch, history=self.history)

    @classmethod
    def load(cls, spark: SparkSession, store: str, version: int | None = None) -> State:
        arrays, values = models.load(spark, store, version)
        own = lambda kind: [np.atleast_1d(arrays[f"{kind}{n}"]) for n in NAMES]
        return cls(own(""), own("first_"), own("second_"), values["step"], values["epoch"], values["history"])


def summed(params: Sequence[np.ndarray], x: np.ndarray, starts: np.ndarray, gold: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[list[np.ndarray], float, int]:
    """Sums over groups of the gradients of their softmax cross-entropies, of these, and of right first places.

    x: all groups' candidates, those of a group from one of ``starts`` on; gold: its gold one's row; keep: what isn't dropped.
    """
    w1, b1, w2, b2 = params
    h = np.maximum(x @ w1 + b1, 0)
    held = h * keep
    s = held @ w2 + b2[0]
    sizes = np.diff(np.append(starts, len(x)))
    top = np.maximum.reduceat(s, starts)
    e = np.exp(s - np.repeat(top, sizes))
    g = e / np.repeat(np.add.reduceat(e, starts), sizes)
    loss = -np.log(np.maximum(g[gold], 1e-300)).sum()
    # The first of equal scores leads.
    leads = np.minimum.reduceat(np.where(s == np.repeat(top, sizes), np.arange(len(s)), len(s)), starts)
    g[gold] -= 1
    back = g[:, None] * w2 * keep * (h > 0)
    return [x.T @ back, back.sum(0), held.T @ g, np.array([g.sum()])], float(loss), int((leads == gold).sum())


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the groups that can be learned from: keys, sizes, places of the gold ones, and all their candidates' features."""
    features, labels = batch.column("numeric_features"), batch.column("labels")
    sizes, n_labels = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (features, labels)]
    row = np.repeat(np.arange(len(sizes)), n_labels)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n_labels) - n_labels, n_labels)
    right = (pc.fill_null(labels.flatten(), 0).to_numpy(zero_copy_only=False) == 1) & (place < sizes[row])
    # Rows are in order, so the first of a row is its first gold one.
    known, first = np.unique(row[right], return_index=True)
    used = np.zeros(len(sizes), bool)
    used[known] = True
    vectors = features.flatten().filter(pa.array(np.repeat(used, sizes)))
    x = pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    return batch.column("key").to_numpy()[known].view(np.uint64), sizes[known], place[right][first], x


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits mixed well (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kept(seed: Sequence[int], keys: np.ndarray, sizes: np.ndarray, hidden: int, dropout: float) -> np.ndarray:
    """Weights of all candidates' hidden units: 0 for those dropped out, which a group's key, the seed and their place tell."""
    for s in seed:
        keys = _mixed(keys + _STEP * np.uint64(s + 1))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = _mixed(np.repeat(keys, sizes) + _STEP * (place.astype(np.uint64) + np.uint64(1)))
    # 64 bits serve four units; weights are by the share that 16 bits make of the dropout.
    drawn = _mixed(own[:, None] + _STEP * np.arange(1, -(-hidden // 4) + 1, dtype=np.uint64)).view(np.uint16)[:, :hidden]
    least = min(round(dropout * 65536), 65535)
    return (drawn >= least) * (1 / (1 - least / 65536))


def _blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Groups in runs of up to ``most`` candidates, one group at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _sums(groups: DataFrame, params, seed: Sequence[int], dropout: float) -> list[dict]:  # noqa: ANN001
    """Rows of summed gradients, losses, hits and numbers of groups, few enough for the driver; ``params`` is broadcast."""
    shapes = [p.shape for p in params.value]

    def flat(gradients: list[np.ndarray]) -> bytes:
        return np.concatenate([g.ravel() for g in gradients]).tobytes()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, loss, hits, n, part = params.value, None, 0.0, 0, 0, 0
        for batch in batches:
            keys, sizes, golds, x = _groups(batch)
            if not len(keys):
                continue
            part = batch.column("part")[0].as_py()
            places = np.append(0, np.cumsum(sizes))
            for some in _blocks(sizes, BLOCK):
                starts = places[some] - places[some.start]
                keep = _kept(seed, keys[some], sizes[some], shapes[0][1], dropout) if dropout else 1.0
                gradients, more, right = summed(own, x[places[some.start] : places[some.stop]], starts, starts + golds[some], keep)
                total = gradients if total is None else [a + b for a, b in zip(total, gradients)]
                loss, hits = loss + more, hits + right
            n += len(keys)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([loss]), pa.array([hits]), pa.array([flat(total)], pa.binary())], names=["part", "n", "loss", "hits", "gradient"])

    def added(rows: pa.Table) -> pa.Table:
        held = sorted(rows.to_pylist(), key=lambda r: r["part"])
        gradient = np.sum([np.frombuffer(r["gradient"]) for r in held], 0).tobytes()
        return pa.table({"part": [held[0]["part"]], "n": [sum(r["n"] for r in held)], "loss": [sum(r["loss"] for r in held)], "hits": [sum(r["hits"] for r in held)], "gradient": pa.array([gradient], pa.binary())})

    rows = groups.select(F.xxhash64("example_id").alias("key"), "numeric_features", "labels", F.spark_partition_id().cast("bigint").alias("part"))
    out = rows.mapInArrow(partial, _SUMS).groupBy(F.floor(F.col("part") / FAN)).applyInArrow(added, _SUMS)
    return sorted((r.asDict() for r in out.collect()), key=lambda r: r["part"])


def judged(groups: DataFrame, model: ListwiseScorer) -> dict:
    """Groups that have a gold candidate, their mean loss, and the share of them whose gold candidate comes first (None without any)."""
    known = groups.sparkSession.sparkContext.broadcast(State.of(model).params)
    rows = _sums(groups, known, (), 0.0)
    known.destroy()
    n = sum(r["n"] for r in rows)
    return {"groups": n, "loss": sum(r["loss"] for r in rows) / n if n else None, "top1": sum(r["hits"] for r in rows) / n if n else None}


def _deal(groups: DataFrame, steps: int, path: str) -> None:
    """Writes groups by batch."""
    batch, salt = F.pmod(F.xxhash64("example_id"), F.lit(steps)), F.pmod(F.xxhash64("example_id", F.lit(1)), F.lit(FAN))
    groups.withColumn("batch", batch).repartition("batch", salt).write.partitionBy("batch").parquet(path)


def trained(
    groups: DataFrame, epochs: int = 10, steps: int = 8, rate: float = 1e-3, decay: float = 1e-5, hidden: int = 128, dropout: float = 0.1, seed: int = 0, validate: DataFrame | None = None, store: str | None = None,
    kept: str | None = None,
) -> State:
    """A scorer trained on all groups, with each epoch's mean loss and its top-1 accuracy (on ``validate``, if that is given).

    steps: batches an epoch.  store: a folder of versions (see ``sources.models``), one an epoch; what it holds is gone on from.
    kept: a folder of the shared file system that isn't there yet, which all columns of the groups are written to, and stay in, so
    that who goes on with the groups needn't make them again.
    """
    spark = groups.sparkSession
    if kept is not None:
        _deal(groups, steps, kept)
    state = State.of(ListwiseScorer.fresh(hidden, seed))
    if store is not None and models.versions(spark, store):
        state = State.load(spark, store)
    if state.epoch >= epochs:
        return state
    held = kept
    if held is None:
        held = shared.folder(spark)
        _deal(groups.select("example_id", "numeric_features", "labels"), steps, held)
    written = spark.read.schema(f"example_id {groups.schema['example_id'].dataType.simpleString()}, numeric_features array<array<double>>, labels array<int>, batch bigint").parquet(held)
    while state.epoch < epochs:
        loss, n, hits = 0.0, 0, 0
        for b in np.random.default_rng([seed, state.epoch]).permutation(steps).tolist():
            known = spark.sparkContext.broadcast(state.params)
            rows = _sums(written.where(F.col("batch") == b), known, (seed, state.epoch), dropout)
            known.destroy()
            some = sum(r["n"] for r in rows)
            if some:
                flat, gradients = np.sum([np.frombuffer(r["gradient"]) for r in rows], 0) / some, []
                for p in state.params:
                    gradients.append(flat[: p.size].reshape(p.shape))
                    flat = flat[p.size :]
                state.adamw(gradients, rate, decay)
            loss, n, hits = loss + sum(r["loss"] for r in rows), n + some, hits + sum(r["hits"] for r in rows)
        state.epoch += 1
        top1 = judged(validate, state.scorer)["top1"] if validate is not None else hits / n if n else None
        state.history.append({"loss": loss / max(1, n), "top1": top1, "groups": n})
        if store is not None:
            state.save(spark, store)
    if kept is None:
        shared.delete(spark, held)
    return state


def best_scorer(spark: SparkSession, store: str) -> ListwiseScorer:
    """The scorer of the epoch of the best top-1 accuracy, or else of the last."""
    last = State.load(spark, store)
    best = last.best()
    return (last if best in (None, last.epoch) else State.load(spark, store, best)).scorer
