"""Whitening of vectors by their covariance's leading eigenvectors.

Each partition's iterator keeps Welford's state of what it has seen: the number of vectors, their mean, and the sum M of
the rank-one updates ``(x - mean before)(x - mean after)^T``, which is ``(i - 1) / i`` times the outer product of the
former factor for the i-th vector; a batch's updates are summed as one matrix product.  Nothing is squared before it is
centred, so a large common offset costs no digits.  Two states merge by the parallel formula: ``M1 + M2 + d d^T n1 n2 / n``
with d the difference of the means.  States are merged in groups of ``FAN`` by rounds until one is left, so neither the
driver nor a task holds more than that many; a state's size depends on the vectors' length only.

The covariance (M over n) goes through a symmetric QR eigen-solve on the driver: Householder reflections to tridiagonal
form, then implicitly shifted QR steps, whose rotations make up the eigenvectors.  Vectors are projected in one more
pass, without a shuffle.

Defined cases: vectors that are null or hold null or non-finite entries are left out, and so are those that aren't of
the most frequent length (the greater of equally frequent ones); components of a variance of numerically zero are left
out, so equal vectors, or a single one, give none; null keys are kept; repeated rows count once each; an empty table
gives an empty one; other columns are kept, and columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.arrow import extended, with_fields
from lexweave.llm.common import Held, cut, quoted, table
from lexweave.llm.vectors import scaled, whole

OFFSET, COMPONENTS = 100_000, 8
#: States that one task merges, and rows whose updates are summed at a time.
FAN, ROWS = 64, 4096
#: Share of the greatest variance up to which one counts as zero.
ZERO = 1e-12
_STATE = "part bigint, n bigint, base binary, mean binary, m binary, sums binary"


@dataclass
class Welford:
    """Number of vectors, mean, and sum of centred outer products; ``sums`` are exact sums of integer vectors.

    The mean is kept as its difference to ``base``, the first vector, so that a common offset takes none of its digits.
    """

    n: int
    base: np.ndarray
    mean: np.ndarray
    m: np.ndarray
    sums: np.ndarray

    @classmethod
    def empty(cls, length: int, integers: bool) -> Welford:
        return cls(0, np.zeros(length), np.zeros(length), np.zeros((length, length)), np.array([0] * length, object) if integers else np.zeros(length))

    def update(self, x: np.ndarray) -> None:
        """Takes the rows of ``x`` in, one after the other: the rank-one updates of all of them in one product."""
        if not len(x):
            return
        if not self.n:
            self.base = x[0].astype(np.float64)
        # Row i's mean before it: differences to the mean before the batch, summed up and divided by their number.
        far = x - self.base - self.mean
        before = np.arange(self.n, self.n + len(x), dtype=np.float64)
        drift = (np.cumsum(far, 0) - far) / np.maximum(before, 1)[:, None]
        delta = far - drift
        self.m += (delta * (before / (before + 1))[:, None]).T @ delta
        self.n += len(x)
        self.mean = self.mean + far.sum(0) / self.n
        self.sums = self.sums + (x.sum(0).astype(object) if self.sums.dtype == object else x.sum(0))

    def merge(self, other: Welford) -> None:
        if not other.n:
            return
        if not self.n:
            self.base = other.base
        n, d = self.n + other.n, other.base - self.base + other.mean - self.mean
        self.m += other.m + np.outer(d, d) * (self.n * other.n / n)
        self.mean = self.mean + d * (other.n / n)
        self.sums, self.n = self.sums + other.sums, n

    def batch(self, part: int) -> pa.RecordBatch:
        sums = ",".join(map(str, self.sums.tolist())).encode()
        arrays = [pa.array([part]), pa.array([self.n]), *[pa.array([v], pa.binary()) for v in (self.base.tobytes(), self.mean.tobytes(), self.m.tobytes(), sums)]]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "n", "base", "mean", "m", "sums"])

    @classmethod
    def of(cls, row: dict, integers: bool) -> Welford:
        mean = np.frombuffer(row["mean"])
        sums = row["sums"].decode().split(",") if row["sums"] else []
        whole = np.array([int(s) for s in sums], object) if integers else np.array([float(s) for s in sums])
        return cls(row["n"], np.frombuffer(row["base"]), mean, np.frombuffer(row["m"]).reshape(len(mean), len(mean)).copy(), whole)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def moments(vectors: DataFrame, vector: str, length: int) -> Welford:
    """Welford's state of all vectors of a column, which are of one length and not null; all its sums are of centred products."""
    integers = isinstance(vectors.schema[vector].dataType.elementType, (T.LongType, T.IntegerType))
    rows = vectors.select(F.col(quoted(vector)).alias("x"), F.spark_partition_id().cast("bigint").alias("part"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = Welford.empty(length, integers), 0
        for batch in batches:
            if batch.num_rows:
                part, x = batch.column("part")[0].as_py(), _matrix(batch.column("x"), length)
                for at in range(0, len(x), ROWS):
                    state.update(x[at : at + ROWS])
        if state.n:
            yield state.batch(part)

    def merged(rows: list[dict]) -> Welford:
        state = Welford.empty(length, integers)
        for r in sorted(rows, key=lambda r: r["part"]):
            state.merge(Welford.of(r, integers))
        return state

    def group(states: pa.Table) -> pa.Table:
        held = states.to_pylist()
        return pa.Table.from_batches([merged(held).batch(held[0]["part"] // FAN)])

    states = cut(rows.mapInArrow(streamed, _STATE))
    while (states.agg(F.max("part")).first()[0] or 0) >= FAN:
        states = cut(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(group, _STATE))
    return merged([r.asDict() for r in states.collect()])


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order, and the unit eigenvectors as columns."""
    a, n = np.array(v, np.float64), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        # The reflection that leaves of column k one entry below the diagonal.
        u = a[k + 1 :, k].copy()
        size = np.sqrt(u @ u)
        if size == 0:
            continue
        u[0] += size if u[0] >= 0 else -size
        u /= np.sqrt(u @ u)
        a[k + 1 :, :] -= 2 * np.outer(u, u @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    d, e, q = np.diag(a).copy(), np.diag(a, 1).copy(), q.T.copy()
    end, steps = n - 1, 0
    while end > 0:
        small = np.abs(e[:end]) <= np.finfo(float).eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0
        if e[end - 1] == 0:
            end -= 1
            continue
        cuts = np.flatnonzero(e[:end] == 0)
        start = int(cuts[-1]) + 1 if len(cuts) else 0
        steps += 1
        if steps > 60 * n:
            raise ArithmeticError("the eigen-solve doesn't converge")
        # Wilkinson's shift, from the last two rows; then the bulge is chased down.
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + (np.hypot(half, e[end - 1]) if half >= 0 else -np.hypot(half, e[end - 1])))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < end:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


@dataclass
class Whitening:
    """A fitted whitening: its state, variances and components (as columns), and the covariance's trace."""

    state: Welford
    variances: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.state.base - self.state.mean) @ self.components) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of integer vectors, the exact sum over dimensions of (n x - sum)^2."""
        n, sums = self.state.n, self.state.sums
        widest = max((abs(int(f) * n - s) for f, s in zip([*x.max(0), *x.min(0)], [*sums, *sums])), default=0)
        if widest * widest * x.shape[1] < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63:
            far = n * x - sums.astype(np.int64)
            return np.einsum("ij,ij->i", far, far).tolist()
        far = n * x.astype(object) - sums
        return (far * far).sum(1).tolist()


def frequent_length(vectors: DataFrame, vector: str) -> int:
    """The most frequent length of a column's vectors, the greater of equally frequent ones; 0 without any."""
    found = vectors.groupBy(F.size(F.col(quoted(vector))).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def fit_whitening(vectors: DataFrame, vector: str, most: int = COMPONENTS) -> Whitening:
    """The ``most`` components of the greatest variance, fitted on all vectors, not null, of the most frequent length."""
    length = frequent_length(vectors, vector)
    state = moments(vectors.where(F.size(F.col(quoted(vector))) == length), vector, length)
    values, columns = symmetric_qr(state.m / max(1, state.n))
    kept = min(most, int((values > ZERO * max(values[:1].max(initial=0.0), 0.0)).sum()) if state.n else 0)
    return Whitening(state, values[:kept], columns[:, :kept], float(np.trace(state.m) / max(1, state.n)))


def whitened(rows: DataFrame, fit: Whitening, vector: str) -> DataFrame:
    """``rows`` with the array ``whitened``, and of integer vectors ``deviation`` (a decimal); for vectors of the fit's length."""
    held = Held(rows, None, vector)
    integers = fit.state.sums.dtype == object
    fields = [T.StructField("whitened", T.ArrayType(T.DoubleType(), False), False)] + ([T.StructField("deviation", T.DecimalType(38, 0))] if integers else [])
    schema, known = with_fields(held.rows.schema, fields), rows.sparkSession.sparkContext.broadcast(fit)
    length, k = len(fit.state.mean), len(fit.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        own = known.value
        for batch in batches:
            x = _matrix(batch.column("t"), length)
            found = own.project(x)
            values = {"whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(found.ravel()))}
            if integers:
                values["deviation"] = [Decimal(v) if v < 10**38 else None for v in own.deviations(x)] if len(x) else []
            yield extended(batch, schema, values)

    return held.back(held.rows.where(F.col("t").isNotNull() & (F.size("t") == length)).mapInArrow(run, schema), [f.name for f in fields])


def identity_error(rows: DataFrame, k: int, column: str = "whitened") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    state = moments(rows, column, k)
    return float(np.abs(state.m / max(1, state.n) - np.eye(k)).max(initial=0.0))


def op13_welford_whitening(spark: SparkSession, sf_dir: str, offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """A deviation of 2^63 or more, which no long holds, is null."""
    vec: Column = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").where(whole(vec)).select("vec_id", scaled(vec, offset).alias("x"))
    fit = fit_whitening(rows, "x", components)
    found = cut(whitened(rows, fit, "x").drop("x"))
    error, shares = identity_error(found, len(fit.variances)), [float(e / fit.trace) for e in fit.variances]
    each = found.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("i") + 1)
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fit.state.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
