"""Whitening of embeddings by streaming moments and a symmetric QR eigen-solve (operator 11).

Every partition streams over its vectors: Welford's update moves the mean and adds one rank-one
term to the scatter for each vector, so nothing but the state (``dim``^2 numbers) is held and
all products are of centred values.  The states of the partitions are merged with the parallel update
formula, a few at a time and in rounds, until one is left; only that comes to the driver, whose
size depends on the dimension and not on the rows.  There the covariance is made
tridiagonal by Householder reflections and diagonal by implicit QR steps with Wilkinson's shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.shared import cut

#: States that one task merges.
FAN_IN = 8
#: Components of the query.
COMPONENTS = 8
#: Whole numbers of the contract: floor(SCALE * entry) + OFFSET; entries of LARGEST or more (in size) count as that.
SCALE, OFFSET, LARGEST = 1024, 100_000, float(1 << 40)

_STATE = "part long, dim int, n long, total binary, mean binary, scatter binary"
_LONG_MAX = (1 << 63) - 1


@dataclass
class Moments:
    """Count, exact sums (of whole numbers), mean and scatter (sum of outer products of centred vectors)."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, np.zeros(dim, np.int64), np.zeros(dim), np.zeros((dim, dim)))

    def add(self, vectors: np.ndarray) -> None:
        """Welford's update for each row: the mean moves, the scatter grows by one rank-one term."""
        if vectors.dtype == np.int64:
            self.total += vectors.sum(0)
        term = np.empty_like(self.scatter)
        for row in vectors.astype(np.float64, copy=False):
            self.n += 1
            before = row - self.mean
            self.mean += before / self.n
            self.scatter += np.multiply.outer(before, row - self.mean, out=term)

    def merged(self, other: Moments) -> Moments:
        """The moments of both sets (parallel update formula)."""
        if not self.n or not other.n:
            return other if not self.n else self
        n, apart = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.multiply.outer(apart, apart) * (self.n * (other.n / n))
        return Moments(n, self.total + other.total, self.mean + apart * (other.n / n), (scatter + scatter.T) / 2)

    @property
    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        values = [part, len(self.mean), self.n, *(a.tobytes() for a in (self.total, self.mean, self.scatter))]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "dim", "n", "total", "mean", "scatter"])

    @classmethod
    def of(cls, row: dict) -> Moments:
        dim = row["dim"]
        return cls(row["n"], np.frombuffer(row["total"], np.int64), np.frombuffer(row["mean"]), np.frombuffer(row["scatter"]).reshape(dim, dim))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the lists in ``column``, which hold no nulls."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(length):
        at = np.flatnonzero(length == dim)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        yield at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(dim))


def _partition_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, Moments] = {}
    for batch in batches:
        for _, vectors in matrices(batch.column(0)):
            states.setdefault(vectors.shape[1], Moments.none(vectors.shape[1])).add(vectors)
    part = TaskContext.get().partitionId()
    yield from (state.row(part) for state in states.values())


def _merge_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    merged = Moments.of(rows[0])
    for r in rows[1:]:
        merged = merged.merged(Moments.of(r))
    return pa.Table.from_batches([merged.row(rows[0]["part"] // FAN_IN)])


def moments(vectors: DataFrame) -> Moments | None:
    """The moments of the one column of ``vectors`` (lists of numbers without nulls): of the length that most rows have, of those the largest; None without rows."""
    states = cut(vectors.mapInArrow(_partition_moments, _STATE))
    while states.groupBy("dim").count().where("count > 1").limit(1).count():
        grouped = states.select(F.expr(f"part div {FAN_IN}").alias("bundle"), "*").groupBy("dim", "bundle")
        states = cut(grouped.applyInArrow(lambda table: _merge_group(table.drop_columns(["bundle"])), _STATE))
    best = states.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return Moments.of(best[0].asDict()) if best else None


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and (by rows) the orthogonal basis of a symmetric matrix, by Householder reflections."""
    a, basis = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        v = x.copy()
        v[0] -= alpha
        length = np.linalg.norm(v)
        if not length:
            continue
        v /= length
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1, k] = alpha
        basis[k + 1 :] -= 2 * np.multiply.outer(v, v @ basis[k + 1 :])
    return a.diagonal().copy(), a.diagonal(-1).copy(), basis


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows; the entry of largest size is positive) of a symmetric matrix."""
    size = len(matrix)
    unit = float(np.abs(matrix).max()) if size else 0.0
    if not unit:
        return np.zeros(size), np.eye(size)
    d, e, basis = _tridiagonal(matrix / unit)
    eps, last, steps = np.finfo(float).eps, size - 1, 0
    while last > 0:
        small = np.abs(e[:last]) <= eps * (np.abs(d[:last]) + np.abs(d[1 : last + 1]))
        e[:last][small] = 0
        if not e[last - 1]:
            last, steps = last - 1, 0
            continue
        if (steps := steps + 1) > 100:
            raise ArithmeticError("the eigenvalues do not converge")
        zeros = np.flatnonzero(e[:last] == 0)
        first = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + np.copysign(np.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            low, high, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * low + 2 * c * s * off + s * s * high, s * s * low - 2 * c * s * off + c * c * high
            e[k] = c * s * (high - low) + (c * c - s * s) * off
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = basis[k].copy()
            basis[k] = c * upper + s * basis[k + 1]
            basis[k + 1] = c * basis[k + 1] - s * upper
    order = np.argsort(-d, kind="stable")
    basis = basis[order]
    basis *= np.sign(np.take_along_axis(basis, np.abs(basis).argmax(1)[:, None], 1))
    return d[order] * unit, basis


def whole_numbers(vector: Column) -> Column:
    """floor(1024 c) + 100000 for each entry, as longs."""
    within = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c))
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(within(c) * SCALE).cast("long") + OFFSET)


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and none of them is null or not finite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector.cast("array<double>"), odd), F.lit(False))


def _whitened_rows(fit: Moments, components: np.ndarray, values: np.ndarray, own: list[str]):
    n, total = fit.n, fit.total
    kept = values > max(0.0, values[0]) * len(total) * np.finfo(float).eps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["_x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(total))
            apart = x * n - total
            scores = np.zeros((len(x), len(values)))
            scores[:, kept] = (apart / n) @ components[kept].T / np.sqrt(values[kept])
            if len(x) and float(np.abs(apart).max()) ** 2 * len(total) < _LONG_MAX / 2:
                exact = pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = pa.array([int(a) for a in (apart.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values)), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), exact, scores], names=[*own, "deviation_exact", "_scores"])

    return run


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error for each usable row of ``rows`` (vec_id, ``vector``; other columns are not read) and component.

    Rows whose vector is null or empty, or holds null or non-finite entries, drop out; so do those of another
    length than most rows have (of equally frequent lengths the largest counts).  Repeated rows and rows without
    vec_id are rows like others.  Entries become floor(1024 c) + 100000 (beyond 2^40 they count as 2^40).
    Components are numbered from 1 by falling variance, at most ``components`` of them and no more than the
    length; a component without variance has whitened 0 and takes no part in identity_error (0 if there is no other), explained is 0 if nothing varies.
    ``deviation`` is null where it exceeds a long; ``deviation_exact`` (a decimal) holds it to 38 digits.
    An empty table gives no rows.
    """
    rows = rows.where(usable(F.col(vector))).select("vec_id", whole_numbers(F.col(vector)).alias("_x"))
    fit = moments(rows.select("_x"))
    schema = "vec_id {}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    covariance = fit.covariance
    values, vectors = symmetric_qr(covariance)
    values, vectors = values[:components], vectors[:components]
    kind = rows.schema["vec_id"].dataType.simpleString()
    scored = rows.where(F.size("_x") == len(fit.mean)).mapInArrow(_whitened_rows(fit, vectors, values, ["vec_id"]), f"vec_id {kind}, deviation_exact decimal(38,0), _scores array<double>")
    scored = cut(scored)
    after = moments(scored.select("_scores")).covariance
    varies = np.flatnonzero(after.diagonal() > 0)
    error = float(np.abs(after[np.ix_(varies, varies)] - np.eye(len(varies))).max()) if len(varies) else 0.0
    trace = float(np.trace(covariance))
    explained = F.array(*[F.lit(max(0.0, float(v)) / trace if trace > 0 else 0.0) for v in values])
    out = scored.select("vec_id", "deviation_exact", F.posexplode("_scores").alias("place", "whitened"))
    return out.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation_exact AS long)").alias("deviation"), "deviation_exact",
        "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
