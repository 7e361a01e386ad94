"""Embedding whitening by contour integration (FEAST).

1. *Moments.* Each task folds its vectors into (n, S, mean, centred second moments); products are of centred values,
   and partial results are joined by the pairwise update of Chan, Golub and LeVeque, ``FAN`` at a time, until one is left. S
   is a whole number and exact. What reaches the driver is one d x d matrix, d being the vectors' length.
2. *Slices.* The covariance is brought to tridiagonal form; the signs of the pivots of T - sI (Sylvester's inertia)
   count the eigenvalues below s. Counting cuts the upper end of the spectrum into intervals of about ``SLICE``
   eigenvalues, with cuts where no eigenvalue lies near.
3. *Contour.* For each interval, a Spark task of its own: Gauss-Legendre quadrature of the resolvent (zI - V)^-1 Y
   along the half circle over the interval, with complex shifted solves, projects Y onto the interval's eigenspace;
   Rayleigh-Ritz on the projected basis gives pairs, which start the next round until the residuals stop at rounding.
4. *Check.* Each interval must hold just as many pairs as the inertia counts say; else its basis grows and it is
   solved again. All pairs go through one last Rayleigh-Ritz, which makes them orthogonal across intervals.
5. *Rows.* Vectors are projected on the components and divided by the root of the eigenvalue; the covariance of the
   results is taken as in 1 and compared with the identity.

Rows with a null vector or with null, NaN or infinite entries are dropped. Entries whose 64-fold lies outside 2^62 are held
there. Should vectors differ in length, those of the most common length (the longer on ties) are kept, as no covariance
spans several. Directions without variance (all of them, for one vector or equal ones) have no component, so no row;
an empty table gives an empty result. Repeated rows count as often as they stand, null ids are kept, tied eigenvalues
get any orthogonal basis of their space. ``deviation`` is null where 64 bits do not hold it. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grid of the entries and their offset.
GRID = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Quadrature points on the half circle, eigenvalues wanted in an interval, rounds of projection.
NODES = 8
SLICE = 8
ROUNDS = 40
#: Partial moments that are joined by one task.
FAN = 32
HELD = float(1 << 62)


# ---- moments


class Moments:
    """Count, exact sums, mean and centred second moments of integer or real rows."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.second = 0, [0] * d, np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        part = Moments(rows.shape[1])
        part.n = len(rows)
        if rows.dtype.kind == "i":
            top = max(abs(int(rows.max())), abs(int(rows.min())))
            exact = rows if top * len(rows) < 1 << 62 else rows.astype(object)
            part.sums = [int(x) for x in exact.sum(axis=0)]
            part.mean = np.array([s / part.n for s in part.sums])
        else:
            part.mean = rows.mean(axis=0)
        away = rows - part.mean
        part.second = away.T @ away
        self.join(part)

    def join(self, other: Moments) -> None:
        if not other.n:
            return
        n = self.n + other.n
        gap = other.mean - self.mean
        self.second += other.second + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean += gap * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self, key: int) -> dict:
        return {"key": key, "n": self.n, "sums": ",".join(map(str, self.sums)), "mean": self.mean.tobytes(), "second": self.second.tobytes()}

    @classmethod
    def of(cls, row: dict) -> Moments:
        mean = np.frombuffer(row["mean"])
        out = cls(len(mean))
        out.n, out.sums = row["n"], [int(s) for s in row["sums"].split(",")]
        out.mean, out.second = mean.copy(), np.frombuffer(row["second"]).reshape(len(mean), -1).copy()
        return out

    @property
    def covariance(self) -> np.ndarray:
        return (self.second + self.second.T) / (2 * self.n)


MOMENTS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("mean", pa.binary()), ("second", pa.binary())])
MOMENTS_DDL = "key bigint, n bigint, sums string, mean binary, second binary"


def matrix_of(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def grid(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) as integers; the offset is left out, as it cancels in all that is centred."""
    return np.clip(np.floor(GRID * entries), -HELD, HELD).astype(np.int64)


def moments(vectors: DataFrame, d: int, values) -> Moments | None:
    """Moments of ``values(entries)`` over all rows of ``vectors``; None without rows."""
    from pyspark import TaskContext

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments(d)
        width = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = values(matrix_of(batch.slice(at, 4096).column("v"), d))
                if width is None:
                    width, held = rows.shape[1], Moments(rows.shape[1])
                held.add(rows)
        if held.n:
            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], schema=MOMENTS)

    def fold(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        held = Moments.of(rows[0])
        for r in rows[1:]:
            held.join(Moments.of(r))
        return pa.Table.from_pylist([held.row(rows[0]["key"] // FAN)], schema=MOMENTS)

    parts = vectors.select("v").mapInArrow(gather, MOMENTS_DDL)
    left = vectors.rdd.getNumPartitions()
    while left > FAN:
        parts = parts.groupBy(F.expr(f"key div {FAN}")).applyInArrow(fold, MOMENTS_DDL)
        left = -(-left // FAN)
    held = None
    for r in sorted(parts.collect(), key=lambda r: r.key):  # FAN rows at most
        part = Moments.of(r.asDict())
        if held is None:
            held = part
        else:
            held.join(part)
    return held


# ---- spectrum


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal form (Householder)."""
    a, d = v.astype(float).copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += math.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues below each shift: negative pivots of T - sI."""
    tiny = np.finfo(float).tiny * 1e16
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(int)
    for a, b in zip(diagonal[1:], off, strict=True):
        pivot = a - shifts - b * b / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def slices(diagonal: np.ndarray, off: np.ndarray, wanted: int, floor: float, size: int = SLICE) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), from the top, that hold the ``wanted`` largest above ``floor``."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    top = float((diagonal + reach).max())
    top += 1e-3 * abs(top) + np.finfo(float).tiny
    above = lambda s: int(d - inertia(diagonal, off, np.array([s]))[0])
    wanted = min(wanted, above(floor))
    cuts, done = [top], 0
    while done < wanted:
        # bisect for the point with ``target`` eigenvalues above it; equal ones come as one
        target, low, high = min(done + size, wanted), floor, cuts[-1]
        while above((low + high) / 2) != target and high - low > 1e-10 * top:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > target else (low, middle)
        cut = (low + high) / 2 if above((low + high) / 2) >= target else low
        # the widest gap around that number of eigenvalues takes the cut away from its neighbours
        count = above(cut)
        edge = [cut, cut]
        for side, far in ((0, floor), (1, cuts[-1])):
            near = cut
            for _ in range(60):
                middle = (near + far) / 2
                near, far = (middle, far) if above(middle) == count else (near, middle)
            edge[side] = near
        cut = sum(edge) / 2 if edge[0] > floor else edge[1] / 2 + floor / 2
        cuts.append(cut)
        done = count
    counts = [above(c) for c in cuts]
    return [(float(low), float(high), b - a) for (high, low), (a, b) in zip(pairwise(cuts), pairwise(counts), strict=True) if b > a]


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, rounds: int = ROUNDS) -> np.ndarray:
    """Orthonormal eigenvectors of ``v`` to the ``count`` eigenvalues inside (low, high)."""
    d = len(v)
    points, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    angles = -np.pi / 2 * (points - 1)
    shifts = centre + radius * np.exp(1j * angles)
    inverse = [np.linalg.inv(z * np.eye(d) - v) for z in shifts]
    spare = count + 4
    pick = np.random.default_rng(d)
    while True:
        basis = pick.standard_normal((d, min(d, count + spare)))
        last = np.inf
        for _ in range(rounds):
            projected = sum((w / 2 * (radius * np.exp(1j * t) * (inv @ basis))).real for w, t, inv in zip(weights, angles, inverse, strict=True))
            basis = np.linalg.qr(projected)[0]
            values, inner = np.linalg.eigh(basis.T @ v @ basis)
            basis = basis @ inner
            inside = (values > low) & (values < high)
            found = basis[:, inside]
            residual = np.abs(v @ found - found * values[inside]).max(initial=0.0)
            if inside.sum() == count and (residual <= 1e-14 * np.abs(v).max() or (residual <= 1e-11 * np.abs(v).max() and residual >= last / 2)):
                return found
            last = residual
        if basis.shape[1] == d:
            raise ArithmeticError(f"{int(inside.sum())} of {count} eigenpairs found between {low} and {high}")
        spare = 2 * spare + count


def components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their eigenvectors as columns. One Spark task per interval."""
    d = len(v)
    floor = d * np.finfo(float).eps * max(float(np.trace(v)), 0.0)
    diagonal, off = tridiagonal(v)
    if not floor or not inertia(diagonal, off, np.array([floor]))[0] < d:
        return np.zeros(0), np.zeros((d, 0))
    parts = slices(diagonal, off, wanted, floor)
    schema = pa.schema([("at", pa.int32()), ("vectors", pa.binary())])

    def solve(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = feast(v, r["low"], r["high"], r["count"])
                yield pa.RecordBatch.from_pylist([{"at": r["at"], "vectors": found.tobytes()}], schema=schema)

    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "at int, low double, high double, count int")
    solved = frame.repartition(len(parts), "at").mapInArrow(solve, "at int, vectors binary").collect()  # d x wanted numbers
    basis = np.hstack([np.frombuffer(r.vectors).reshape(d, -1) for r in sorted(solved, key=lambda r: r.at)])
    if basis.shape[1] != sum(p[2] for p in parts):
        raise ArithmeticError("the intervals hold other numbers of eigenpairs than the inertia counts say")
    basis = np.linalg.qr(basis)[0]
    values, inner = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (basis @ inner)[:, order]


# ---- rows


def deviations(points: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None outside 64 bits."""
    top = max(n * max(abs(int(points.max())), abs(int(points.min()))), *(abs(s) for s in sums), 0)
    if (2 * top) ** 2 * points.shape[1] < 1 << 63:
        away = n * points - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * points.astype(object) - np.array(sums, object)
    return [int(x) if x < 1 << 63 else None for x in (away * away).sum(axis=1)]


def vectors_of(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (doubles) of the rows whose vector is whole."""
    v = table[embedding].cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.select(table[vec_id].cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False)))


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, wanted: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component; see RESULT."""
    spark = table.sparkSession
    whole = vectors_of(table, vec_id, embedding)
    sizes = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    d = sizes.d
    whole = whole.where(F.size("v") == d)
    fit = moments(whole, d, grid)
    values, basis = components(spark, fit.covariance, wanted)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    n, sums = fit.n, fit.sums
    mean, scaled = np.array([s / n for s in sums]), basis / np.sqrt(values)
    explained = values / np.trace(fit.covariance)
    project = lambda entries: (grid(entries) - mean) @ scaled
    error = float(np.abs(moments(whole, d, project).covariance - np.eye(len(values))).max())
    k = len(values)
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                m = part.num_rows
                entries = matrix_of(part.column("v"), d)
                turn = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(turn)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array(deviations(grid(entries), n, sums), pa.int64()).take(pa.array(turn)),
                    pa.array(project(entries).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], schema=schema)

    return whole.mapInArrow(rows, RESULT)
