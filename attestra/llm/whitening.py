"""Whitening of embeddings: exact distributed covariance, eigenvectors refined from single precision.

Fit. Vectors are integers; each distinct one counts once. One pass adds up their components, a second
adds up products of components centred by the rounded means. Both are sums of integers, merged by Spark
in two halves, so the covariance is exact whatever the partitioning or the order of tasks; what the
rounded means leave is taken off in whole numbers. Only dimension x dimension sums reach the driver
(``DIMENSION_LIMIT``).

Eigenvectors. A float32 solution starts an iteration by Ogita and Aishima (2018, 2019) in extended
precision: with R = I - X'X and S = X'VX the correction E_ij = (S_ij + l_j R_ij) / (l_j - l_i) is added as
X E; it consists of matrix products and converges quadratically. Eigenvalues closer than the residual's
bound form a cluster: there only R / 2 is added, and a small symmetric problem, X_c'(V - m I)X_c around
the cluster's mean m, is solved in double precision and turns the cluster's vectors. Eigenvalues that are
equal to the last digit keep any orthonormal basis.

Defined results: vectors as in ``vectors.usable_vectors``. Components without variance (less than
dimension x 2^-52 of the largest eigenvalue) give no rows, nor does a table of one distinct vector or
none. ``deviation`` is null where it exceeds 64 bits. Repeated rows and null ids are projected row by
row. The component of largest size in an eigenvector is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import cut
from attestra.llm.vectors import integer_matrix, usable_vectors

DIMENSION_LIMIT = 2048
HALF = 40
EXTENDED = np.longdouble
STEPS = 30


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product of integer matrices as exact integers, in floating point where no sum can leave 2^53."""
    size = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if size < 2**53:
        return (left.astype(float) @ right.astype(float)).astype(np.int64)
    if size < 2**63:
        return left @ right
    return left.astype(object) @ right.astype(object)


def exact_sums(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Sums over all rows of a vector of integers that ``add`` makes of a batch's matrix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(integer_matrix(batch.column(0))).astype(object)
                total = part if total is None else total + part
        if total is not None:
            values = total.tolist()
            yield pa.RecordBatch.from_pydict(
                {"place": pa.array(range(len(values)), pa.int32()),
                 "high": pa.array([v >> HALF for v in values], pa.int64()),
                 "low": pa.array([v & ((1 << HALF) - 1) for v in values], pa.int64())}
            )

    parts = rows.select("x").mapInArrow(task, "place int, high long, low long")
    sums = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(r["high"] << HALF) + r["low"] for r in sorted(sums, key=lambda r: r["place"])]


@dataclass(frozen=True)
class Moments:
    """Number of distinct vectors, their component sums and n^2 times their covariance, all exact."""

    n: int
    sums: list[int]
    scaled: list[list[int]]

    def covariance(self) -> np.ndarray:
        square = EXTENDED(str(self.n**2))
        return np.array([[EXTENDED(str(v)) / square for v in row] for row in self.scaled])

    def trace(self) -> float:
        return sum(self.scaled[i][i] for i in range(len(self.sums))) / self.n**2


def moments(distinct: DataFrame) -> Moments | None:
    """Two passes over distinct vectors."""

    def counted(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(rows)], exact_product(np.ones((1, len(rows)), np.int64), rows)[0]])

    found = exact_sums(distinct, counted)
    if not found:
        return None
    n, sums = found[0], found[1:]
    if len(sums) > DIMENSION_LIMIT:
        raise ValueError(f"vectors have more than {DIMENSION_LIMIT} components")
    means = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(len(sums))

    def products(rows: np.ndarray) -> np.ndarray:
        centred = rows - means
        return exact_product(centred.T, centred)[upper]

    cells = exact_sums(distinct, products)
    left = [s - n * int(m) for s, m in zip(sums, means)]
    scaled = [[0] * len(sums) for _ in sums]
    for i, j, cell in zip(upper[0].tolist(), upper[1].tolist(), cells):
        scaled[i][j] = scaled[j][i] = n * cell - left[i] * left[j]
    return Moments(n, sums, scaled)


def norm(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum())


def turn_cluster(a: np.ndarray, vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Vectors of one cluster turned to the eigenvectors of their own small problem."""
    small = vectors.T @ (a @ vectors - centre * vectors)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if size <= len(a) * np.finfo(EXTENDED).eps * norm(a):
        return vectors
    _, rotation = np.linalg.eigh((small / size).astype(np.float64))
    return vectors @ rotation.astype(EXTENDED)


def refined_eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.abs(covariance).max()
    if scale == 0:
        return np.zeros(len(covariance), EXTENDED), np.eye(len(covariance), dtype=EXTENDED)
    a = covariance.astype(EXTENDED) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXTENDED)
    one = np.eye(len(a), dtype=EXTENDED)
    for _ in range(STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= bound
        step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, EXTENDED(1), gap))
        x = x + x @ step
        order = np.argsort(values, kind="stable")
        x, values = x[:, order], values[order]
        edges = [0, *(np.flatnonzero(np.diff(values) > bound) + 1).tolist(), len(values)]
        for start, end in zip(edges, edges[1:]):
            if end - start > 1:
                x[:, start:end] = turn_cluster(a, x[:, start:end], values[start:end].mean())
        if np.abs(step).max() <= 8 * np.finfo(EXTENDED).eps:
            break
    x = x[:, ::-1] / np.sqrt((x[:, ::-1] ** 2).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values * scale, x * signs


@dataclass(frozen=True)
class Whitening:
    """Projection ``(x - mean) @ directions`` onto components of variance one."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]

    def project(self, rows: np.ndarray) -> np.ndarray:
        # Whole means are taken off as integers first; only the fraction left is rounded.
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((rows - whole).astype(float) - rest) @ self.directions

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        most = float(np.abs(rows).max(initial=0)) * self.n + float(max(map(abs, self.sums)))
        if most * most * rows.shape[1] < 2**62:
            gaps = self.n * rows - np.array(self.sums, np.int64)
            return (gaps * gaps).sum(axis=1).tolist()
        gaps = self.n * rows.astype(object) - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (gaps * gaps).sum(axis=1).tolist()]


def fit_whitening(distinct: DataFrame, components: int) -> Whitening | None:
    """Whitening onto the leading components of distinct vectors; None if nothing varies."""
    found = moments(distinct)
    if found is None:
        return None
    values, vectors = refined_eigenvectors(found.covariance())
    bar = max(values[0], 0) * len(values) * EXTENDED(2.0**-52)
    kept = [i for i in range(min(components, len(values))) if values[i] > bar]
    if not kept:
        return None
    directions = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float64)
    trace = found.trace()
    return Whitening(found.n, found.sums, directions, [float(values[i]) / trace for i in kept])


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the measured covariance of whitened vectors minus the identity."""
    k = fitted.directions.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                rows = fitted.project(integer_matrix(batch.column(0)))
                sums += rows.sum(axis=0)
                products += rows.T @ rows
        values = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(values)), pa.int32()), "value": pa.array(values)})

    parts = distinct.select("x").mapInArrow(task, "place int, value double")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(k + k * k)
    for r in rows:
        values[r["place"]] = r["value"]
    means = values[:k] / fitted.n
    covariance = values[k:].reshape(k, k) / fitted.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(
    rows: DataFrame,
    components: int = 4,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained,
    identity_error."""
    schema = (
        "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    vectors = usable_vectors(rows, scale, id_column, vector_column)
    distinct = cut(vectors.select("x").distinct())
    fitted = fit_whitening(distinct, components)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, fitted)
    k = len(fitted.explained)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = integer_matrix(batch.column("x"))
                count = len(matrix)
                spread = np.repeat(np.arange(count), k)
                deviations = pa.array(fitted.deviation(matrix), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column("id").take(pa.array(spread)),
                     "component": pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                     "n": pa.array(np.full(count * k, fitted.n)),
                     "deviation": deviations.take(pa.array(spread)),
                     "whitened": pa.array(fitted.project(matrix).ravel()),
                     "explained": pa.array(np.tile(fitted.explained, count)),
                     "identity_error": pa.array(np.full(count * k, error))}
                )

    return vectors.select("id", "x").mapInArrow(task, schema)
