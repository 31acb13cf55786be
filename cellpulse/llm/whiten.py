"""Whitening of embeddings by their leading principal components.

Vectors are put on a grid of integers, so that counts and sums are exact and
equal vectors are one. Spark forms the centred covariance of the distinct
vectors: a block product per task, added up by matrix row. The matrix is as
wide as a vector, whatever the number of rows, and the eigenproblem is solved
on it: Householder reflections make it tridiagonal, Sturm counts bisect its
largest eigenvalues, inverse iteration finds their vectors, and vectors of
close eigenvalues are made orthogonal to each other as they are found. The
components then go to the tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import written

#: Steps of the integer grid per unit.
GRID = 256
#: Components returned.
COMPONENTS = 4
#: Rows multiplied at a time.
STEP_ROWS = 2_000
#: Eigenvalues nearer than this share of the largest form a cluster.
CLUSTER = 1e-3
#: An eigenvalue below this share of the trace is rounding: no component.
LEAST = 1e-12


# --- the eigenproblem of one symmetric matrix -------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that bring a symmetric matrix to this form."""
    a = np.array(matrix, float)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        v = np.zeros(n - k - 1)
        if size > 0:
            v[:] = x
            v[0] += np.copysign(size, x[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = -np.copysign(size, x[0])
        reflections.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(n - 1)]), reflections


def smaller_than(diagonal: np.ndarray, squares: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each point."""
    tiny = 1e-200  # the matrix is scaled to entries of 1
    count = np.zeros(len(points), np.int64)
    q = np.ones(len(points))
    for i, d in enumerate(diagonal):
        q = d - points - (squares[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected as far as doubles go."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    high += np.maximum(np.abs(high), np.abs(low)) * 1e-12 + np.finfo(float).tiny
    wanted = n - np.arange(k)  # the j-th largest has n - j smaller ones
    while True:
        mid = low + (high - low) / 2
        open_ = (mid > low) & (mid < high)
        if not open_.any():
            return mid
        above = smaller_than(diagonal, off * off, mid) >= wanted
        high = np.where(open_ & above, mid, high)
        low = np.where(open_ & ~above, mid, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - value) x = b by elimination with row exchanges; zero pivots become ``least``."""
    n = len(diagonal)
    d, x = (diagonal - value).tolist(), b.tolist()
    u, w = off.tolist() + [0.0], [0.0] * n
    for i in range(n - 1):
        lower = float(off[i])
        if abs(lower) > abs(d[i]):
            # Exchange rows i and i + 1: the next row has one entry more.
            f = d[i] / lower
            d[i], u_i = lower, u[i]
            u[i], w[i] = d[i + 1], u[i + 1]
            d[i + 1], u[i + 1] = u_i - f * u[i], -f * w[i]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            if abs(d[i]) < least:
                d[i] = least
            f = lower / d[i]
            d[i + 1] -= f * u[i]
            x[i + 1] -= f * x[i]
    if abs(d[-1]) < least:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        s = x[i]
        if i + 1 < n:
            s -= u[i] * x[i + 1]
        if i + 2 < n:
            s -= w[i] * x[i + 2]
        x[i] = s / d[i]
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the tridiagonal matrix, one row per value: inverse iteration.

    The vectors of a cluster of close values are kept orthogonal to those
    found before, in every step.
    """
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least = size * np.finfo(float).eps
    rng = np.random.default_rng(1)
    found: list[np.ndarray] = []
    for j, value in enumerate(values):
        first = j
        while first and values[first - 1] - values[first] <= CLUSTER * max(abs(values[0]), np.finfo(float).tiny):
            first -= 1
        x = rng.standard_normal(len(diagonal))
        x /= np.linalg.norm(x)
        for _ in range(6):
            x = _solve(diagonal, off, value, x, least)
            x /= np.abs(x).max()
            for _ in range(2):  # once more against cancellation
                for y in found[first:j]:
                    x -= (x @ y) * y
            x /= np.linalg.norm(x)
        found.append(x)
    return np.array(found)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors (one a row; largest entry positive)."""
    n = len(matrix)
    k = min(k, n)
    if k == 0:
        return np.zeros(0), np.zeros((0, n))
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(k), np.eye(k, n)
    diagonal, off, reflections = tridiagonal(np.asarray(matrix) / size)
    values = leading_values(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        part = vectors[:, at + 1:]
        part -= 2 * np.outer(part @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return values * size, vectors * np.where(signs == 0, 1, signs)[:, None]


# --- sums over the vectors, in Spark ----------------------------------------------

def usable(vector: Column) -> Column:
    """Not null, and every entry a finite number."""
    def fine(c: Column) -> Column:
        d = c.cast("double")
        return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def on_grid(vector: Column, grid: int = GRID) -> Column:
    """Each entry as a whole number of grid steps, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(grid)).cast("long"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _steps(batches: Iterator[pa.RecordBatch], width: int, column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield _rows(batch.column(column).slice(at, STEP_ROWS), width)


def sums(fit: DataFrame, width: int) -> list[int]:
    """Exact sum per dimension: the tasks add the two halves of each number apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _steps(batches, width):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i int, high bigint, low bigint")
    whole = [0] * width
    for r in parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect():
        whole[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return whole


def covariance(fit: DataFrame, width: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Centred covariance (divisor n) of the vectors ``x`` of ``fit``: each task's product, added up by matrix row."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for x in _steps(batches, width):
            centred = x - mean
            total += centred.T @ centred
            seen = True
        if seen:
            # The upper half is enough.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array([total[i, i:] for i in range(width)], pa.list_(pa.float64()))], ["i", "row"])

    def added(table: pa.Table) -> pa.Table:
        rows = table["row"].combine_chunks()
        whole = _rows(rows, len(rows[0]))
        return pa.table({"i": table["i"][:1], "row": pa.array([whole.sum(axis=0)], pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(products, "i int, row array<double>")
    out = np.zeros((width, width))
    for r in parts.groupBy("i").applyInArrow(added, "i int, row array<double>").collect():
        out[r["i"], r["i"]:] = out[r["i"]:, r["i"]] = r["row"]
    return out / n


def identity_error(fit: DataFrame, width: int, projection: np.ndarray, mean: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity.

    Each task centres its own rows; tasks are merged with what their means differ by.
    """
    k = len(projection)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, centre, scatter = 0, np.zeros(k), np.zeros((k, k))
        for x in _steps(batches, width):
            y = (x - mean) @ projection.T
            count, centre, scatter = _merged((count, centre, scatter), (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([centre]), pa.array([scatter.ravel()])], ["n", "centre", "scatter"])

    whole = (0, np.zeros(k), np.zeros((k, k)))
    for r in fit.select("x").mapInArrow(moments, "n bigint, centre array<double>, scatter array<double>").collect():
        whole = _merged(whole, (r["n"], np.array(r["centre"]), np.array(r["scatter"]).reshape(k, k)))
    return float(np.abs(whole[2] / n - np.eye(k)).max(initial=0.0))


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _projected(width: int, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, error: float):
    mean = np.array([s / n for s in total])
    k = len(values)
    scale = 1 / np.sqrt(values)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) squared per row, exactly; null where it has more than 63 bits."""
        widest = max(n * int(np.abs(x).max(initial=0)), max(map(abs, total), default=0))
        if (2 * widest) ** 2 * width < 2 ** 63:
            apart = n * x - np.array(total)
            return (apart * apart).sum(axis=1).tolist()
        exact = (sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x.tolist())
        return [v if v < 2 ** 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                ids = batch.column(0).slice(at, STEP_ROWS)
                x = _rows(batch.column(1).slice(at, STEP_ROWS), width)
                white = ((x - mean) @ vectors.T) * scale
                take = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)), pa.array(deviations(x), pa.int64()).take(take),
                    pa.array(white.ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(x) * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, grid: int = GRID, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Project every vector on the leading components of the distinct ones, to unit variance.

    Returns, per row and component: ``vec_id``, ``component`` (from 1, by
    falling variance), ``n`` (distinct vectors), ``deviation`` (sum of squares
    of n x - S, exact; null where 63 bits do not hold it), ``whitened``,
    ``explained`` (the component's share of the variance) and
    ``identity_error`` (one value for the table).

    Rows whose vector is null or holds a null or non-finite entry are left
    out. Vectors of different lengths have no covariance: each length is a
    table of its own. Repeated vectors are fitted once and all returned; null
    and repeated ids pass through. Vectors without variance (one distinct
    vector, or none, or of length 0) have no components and hence no rows, and
    there are fewer than ``components`` where the variance has fewer
    dimensions. An empty table gives an empty result; other columns are ignored.
    """
    typ = dict(vectors.dtypes)[id_col]
    schema = (f"vec_id {typ}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    rows = (vectors.where(usable(F.col(vector_col)))
            .select(F.col(id_col).alias("vec_id"), on_grid(F.col(vector_col), grid).alias("x")))
    fit = written(rows.select("x").distinct(), "whiten-fit")
    out = vectors.sparkSession.createDataFrame([], schema)
    widths = fit.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()
    for width, n in sorted((r["width"], r["n"]) for r in widths if r["width"]):
        here = fit.where(F.size("x") == width)
        total = sums(here, width)
        mean = np.array([s / n for s in total])
        matrix = covariance(here, width, mean, n)
        trace = float(np.trace(matrix))
        values, found = leading(matrix, components)
        real = values > LEAST * trace
        values, found = values[real], found[real]
        if not len(values):
            continue
        error = identity_error(here, width, found / np.sqrt(values)[:, None], mean, n)
        out = out.unionByName(rows.where(F.size("x") == width).mapInArrow(
            _projected(width, n, total, values, found, trace, error), schema))
    return out
