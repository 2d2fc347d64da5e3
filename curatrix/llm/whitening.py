"""Whitening of embeddings by the leading components of their covariance.

The covariance is gathered over distinct quantised vectors: tasks drop their own repeats, one shuffle by a 128-bit key drops the
others, and each task sends the sums of its centred products, a row of the matrix at a time. What reaches the driver is one matrix of
dims x dims, whatever the number of rows. There Householder reflections make it tridiagonal, bisection on Sturm counts finds the
leading eigenvalues, and inverse iteration, made orthogonal anew within clusters of close eigenvalues, their vectors. The projection is
broadcast (dims x components numbers) and each row is multiplied where it lies.
"""

from __future__ import annotations

import dataclasses
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread, stage, table

COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this are no usable numbers: what they are scaled to would not be exact.
MOST = float(1 << 46)
#: Keys of distinct vectors that a task remembers before it sends repeats again.
REMEMBERED = 500_000
#: Partial sums meet in so many tasks before they go to the driver.
GROUPS = 64
#: Eigenvalues below this share of the largest count as zero; they have no component.
LEAST_SHARE = 1e-12


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What was fitted: n distinct vectors with their exact sums, and the components as columns of ``vectors``."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Quantised vectors less their mean: an exact difference of whole numbers less a fraction."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x) @ (self.vectors / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Of each vector the exact sum of (n * x - S) ** 2."""
        whole, rest = np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)
        far = x - whole
        if len(far) and self.dims * (self.n * (int(np.abs(far).max()) + 1)) ** 2 >= 1 << 63:
            far, rest = far.astype(object), rest.astype(object)
        return [int(d) for d in ((far * self.n - rest) ** 2).sum(axis=1)]


def quantised(column: pa.Array, dims: int, scale: int = SCALE, offset: int = OFFSET) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable vectors of a column, and their whole numbers (vectors, dims)."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = length == dims
    values = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = (np.abs(np.nan_to_num(values, nan=np.inf)) < MOST).all(axis=1)
    return np.flatnonzero(right)[fine], np.floor(scale * values[fine]).astype(np.int64) + offset


def _packed(x: np.ndarray, offset: int) -> list[bytes]:
    """Each vector in four bytes a number where all of its numbers fit, else in eight: equal vectors have equal bytes."""
    near = x - offset
    fits = (np.abs(near) < 1 << 31).all(axis=1)
    small = near.astype("<i4")
    return [small[k].tobytes() if fit else near[k].astype("<i8").tobytes() for k, fit in enumerate(fits.tolist())]


def _unpacked(raw: list[bytes], dims: int, offset: int) -> np.ndarray:
    return np.array([np.frombuffer(r, "<i4" if len(r) == 4 * dims else "<i8") for r in raw], np.int64).reshape(-1, dims) + offset


def _distinct(dims: int, scale: int, offset: int):
    """(key, x) of this task's vectors, most of its repeats left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as h

        seen: set[bytes] = set()
        for batch in slices(batches, 4096):
            keys, kept = [], []
            for x in _packed(quantised(batch.column("vector"), dims, scale, offset)[1], offset):
                if (key := h(x)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    kept.append(x)
            if len(seen) > REMEMBERED:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kept, pa.binary())], names=["key", "x"])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector once; rows come by key and vector."""
    before = None
    for batch in batches:
        kept = []
        for x in batch.column("x").to_pylist():
            if x != before:
                kept.append(x)
                before = x
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], names=["x"])


_LOW = np.int64((1 << 32) - 1)


def _sums(dims: int, offset: int):
    """(part, n, low, high) of this task: exact sums of the numbers' lower 32 bits and of what is above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in slices(batches, 4096):
            x = _unpacked(batch.column("x").to_pylist(), dims, offset)
            n, low, high = n + len(x), low + (x & _LOW).sum(axis=0), high + (x >> 32).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([n], pa.int64()), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["part", "n", "low", "high"])

    return run


def _products(name: str, made):
    """(row, data): the rows of this task's sum of products of what ``made`` gives, from the diagonal on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, 4096):
            if batch.num_rows:
                c = made(batch.column(name).to_pylist())
                total = c.T @ c + (0 if total is None else total)
        rows = [] if total is None else [total[k, k:].tobytes() for k in range(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows, pa.binary())], names=["row", "data"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a matrix, added up."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, data in zip(*(batch.column(c).to_pylist() for c in ("row", "data"))):
            found[row] = found.get(row, 0) + np.frombuffer(data)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["row", "data"])


def _matrix(parts: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix (size, size) that all tasks' rows add up to."""
    out = np.zeros((size, size))
    for r in parts.repartition("row").mapInArrow(_added, "row int, data binary").collect():  # a row for each dimension
        out[r.row, r.row :] = out[r.row :, r.row] = np.frombuffer(r.data)
    return out


# Eigenvalues and eigenvectors of a symmetric matrix.


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the Householder reflections that lead there (of column k, from row k + 1 on)."""
    a = np.array(matrix, np.float64)
    n = len(a)
    off, reflections = np.zeros(max(0, n - 1)), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) == 0:
            off[k] = x[0]
            reflections.append(np.zeros(len(x)))
            continue
        off[k] = -math.copysign(length, x[0])
        v = x.copy()
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        below = a[k + 1 :, k + 1 :]
        p = 2 * (below @ v)
        w = p - (v @ p) * v
        below -= np.outer(v, w) + np.outer(w, v)
        reflections.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return a.diagonal().copy(), off, reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each of some places."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0.0))) / np.finfo(float).eps
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    n, reach = len(diagonal), np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    want = n - 1 - np.arange(k)
    low, high = np.full(k, np.min(diagonal - reach)), np.full(k, np.max(diagonal + reach))
    pad = 1e-12 * max(1e-300, float(np.abs(low[0])), float(np.abs(high[0])))
    low, high = low - pad, high + pad
    for _ in range(256):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= 2e-16 * np.maximum(np.abs(low), np.abs(high)))):
            break
        under = below(diagonal, off, middle) <= want
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves (T - shift) y = b by elimination with row exchanges; vanishing pivots count as ``least``."""
    n = len(diagonal)
    d, up, up2, low, swapped = (diagonal - shift).tolist(), off.tolist(), [0.0] * n, off.tolist(), [False] * n
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            if abs(d[i]) < least:
                d[i] = least
            low[i] /= d[i]
            d[i + 1] -= low[i] * up[i]
        else:
            factor, swapped[i] = d[i] / low[i], True
            d[i], low[i] = low[i], factor
            up[i], d[i + 1] = d[i + 1], up[i] - factor * d[i + 1]
            if i < n - 2:
                up2[i], up[i + 1] = up[i + 1], -factor * up[i + 1]
    if abs(d[-1]) < least:
        d[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - low[i] * y[i + 1]
            else:
                y[i + 1] -= low[i] * y[i]
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                y[i] -= up[i] * y[i + 1]
            if i < n - 2:
                y[i] -= up2[i] * y[i + 2]
            y[i] /= d[i]
        return np.array(y)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling eigenvalues, as columns: inverse iteration; those of a cluster are made orthogonal in every step."""
    n, eps = len(diagonal), np.finfo(float).eps
    norm = float(np.max(np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0)), initial=0.0)) or 1.0
    rng, found, shift, cluster = random.Random(13), np.zeros((n, len(values))), math.inf, 0
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        shift = min(value, shift - 10 * eps * norm) if k > cluster else value  # equal ones are told apart
        solve = _solver(diagonal, off, shift, eps * norm)
        y = np.array([rng.uniform(-1, 1) for _ in range(n)])
        for _ in range(5):
            y = solve(y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):
                y -= found[:, cluster:k] @ (found[:, cluster:k].T @ y)
            y /= np.linalg.norm(y)
        found[:, k] = y
    return found


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k leading eigenvalues, falling, and unit eigenvectors as columns; those that vanish are left out."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading(diagonal, off, min(k, len(matrix)))
    values = values[values > LEAST_SHARE * max(0.0, values[0])] if values[0] > 0 else values[:0]
    vectors = eigenvectors(diagonal, off, values)
    for k, v in reversed(list(enumerate(reflections))):
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values, vectors


def _length(rows: DataFrame) -> int:
    """The most common length of usable vectors (ties: the longest), zero where there is none."""
    usable = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST)) & (F.size("vector") > 0)
    found = rows.filter(F.col("vector").isNotNull() & usable).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found.dims if found else 0


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[Whitening, DataFrame] | None:
    """The components of the distinct quantised vectors of a column ``vector``, and the table of these; None where no vector is usable."""
    dims = _length(rows)
    if not dims:
        return None
    # The key deals the vectors out; whether two are equal their bytes decide.
    fit = rows.select("vector").mapInArrow(_distinct(dims, scale, offset), "key binary, x binary").repartition("key").sortWithinPartitions("key", "x").mapInArrow(_firsts, "x binary")
    fit = stage(fit, "vectors")
    parts = fit.mapInArrow(_sums(dims, offset), "part int, n long, low array<long>, high array<long>").repartition(GROUPS, "part").mapInArrow(_summed, "n long, low array<long>, high array<long>")
    sums = parts.collect()  # GROUPS rows at most
    n = sum(r.n for r in sums)
    totals = tuple(sum(r.low[k] + (r.high[k] << 32) for r in sums) for k in range(dims))
    centred = Whitening(n, totals, np.zeros(0), np.zeros((dims, 0)), 0.0)
    covariance = _matrix(fit.mapInArrow(_products("x", lambda raw: centred.apart(_unpacked(raw, dims, offset))), "row int, data binary"), dims) / n
    values, vectors = principal(covariance, components)
    return Whitening(n, totals, values, vectors, float(np.trace(covariance))), fit


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's partial sums."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([sum(r["n"] for r in rows)], pa.int64()), *(pa.array([[sum(x) for x in zip(*(r[c] for r in rows))]], pa.list_(pa.int64())) for c in ("low", "high"))], names=["n", "low", "high"])


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained and identity_error for each usable row and component.

    Rows whose vector is null or empty, holds a null, a non-finite number or one of 2 ** 46 or more, or has another length than most usable
    vectors (ties: the longest) are left out. Repeated rows and copies count once in the fit and each get their rows; a null id stays
    null. Components are those of eigenvalues above zero, so that fewer than two distinct vectors, and an empty table, give no rows.
    Equal eigenvalues have any orthonormal vectors, the same for all rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    fitted = fit_whitening(rows, components, scale, offset)
    if fitted is None or not len(fitted[0].eigenvalues):
        return spark.createDataFrame([], f"{shape}, identity_error double")
    model, fit = fitted
    k, dims = len(model.eigenvalues), model.dims
    shared = spark.sparkContext.broadcast(model)  # dims x components numbers
    products = fit.mapInArrow(_products("x", lambda raw: shared.value.whitened(_unpacked(raw, dims, offset))), "row int, data binary")
    error = float(np.abs(_matrix(products, k) / model.n - np.eye(k)).max())  # the mean is zero by construction

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.eigenvalues / m.trace
        for batch in slices(batches, 4096):
            places, x = quantised(batch.column("vector"), dims, scale, offset)
            deviation = pa.array(m.deviation(x), pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [batch.column("vec_id").take(pa.array(places)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), m.n, np.int64)), deviation.take(each), pa.array(m.whitened(x).ravel()), pa.array(np.tile(explained, len(x)))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(project, shape).withColumn("identity_error", F.lit(error))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    found = whiten(spread(table(spark, sf_dir, "embeddings")))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
