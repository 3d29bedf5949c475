"""Product codes of vectors: codebooks fitted in rounds, nearest entries found by Orchard's search.

A vector is cut into equal parts; each part position has a codebook. For every entry of a codebook a list
of the other entries by falling nearness is kept. A search starts at some entry, walks its list, and jumps
to the list of any entry that is nearer to the point. Entries seen are marked and measured once. The walk
ends where the list's entries are further from the current entry than twice the point's distance: by the
triangle inequality none of them can be nearer, nor as near. All points of an Arrow batch walk together,
one list step at a time.

Each round is one scan: tasks add up the parts of each entry, Spark adds the tasks' sums, and only the
codebooks themselves (parts x entries x width integers) reach the driver. Everything is integer, so the
codebooks do not depend on how the table is cut or on tasks that run twice.

Defined results: vectors as in ``vectors.usable_vectors``. The first codebooks are the parts of the
smallest ids; fewer ids give fewer entries. A repeated id gives its smallest vector there and is coded row
by row. Null ids come last there. A length that is no multiple of ``parts`` is an error. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import cut
from attestra.llm.vectors import integer_matrix, usable_vectors
from attestra.operators.topk import fits_broadcast

BROADCAST_LABELS = 1 << 18


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the other entries, nearest first, and their squared distances to it."""
    n = len(book)
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    others = order[order != np.arange(n)[:, None]].reshape(n, n - 1)
    return others, np.take_along_axis(gaps, others, axis=1)


def orchard_search(
    points: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every point (ties: lower index), its squared distance, distances measured."""
    others, gaps = lists
    n, last = len(points), len(book) - 1
    entry = np.zeros(n, np.int64)
    distance = ((points - book[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, len(book)), bool)
    seen[:, 0] = True
    step = np.zeros(n, np.int64)
    walking = np.arange(n) if last else np.zeros(0, np.int64)
    measured = n
    while len(walking):
        at, to = entry[walking], step[walking]
        goes_on = to < last
        goes_on[goes_on] = gaps[at[goes_on], to[goes_on]] <= 4 * distance[walking[goes_on]]
        walking, at, to = walking[goes_on], at[goes_on], to[goes_on]
        met = others[at, to]
        step[walking] += 1
        fresh = ~seen[walking, met]
        rows, met = walking[fresh], met[fresh]
        seen[rows, met] = True
        found = ((points[rows] - book[met]) ** 2).sum(axis=1)
        measured += len(rows)
        nearer = (found < distance[rows]) | ((found == distance[rows]) & (met < entry[rows]))
        rows = rows[nearer]
        entry[rows], distance[rows], step[rows] = met[nearer], found[nearer], 0
    return entry, distance, measured


@dataclass(frozen=True)
class Codebooks:
    """``entries``: parts x entries x width."""

    entries: np.ndarray

    def lists(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [neighbour_lists(book) for book in self.entries]

    def nearest(self, vectors: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part of each vector."""
        parts, _, width = self.entries.shape
        cuts = vectors.reshape(len(vectors), parts, width)
        found = [orchard_search(cuts[:, p], self.entries[p], lists[p])[:2] for p in range(parts)]
        return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows x parts) stand for."""
        chosen = self.entries[np.arange(len(self.entries)), codes]
        return chosen.reshape(len(codes), -1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    ids = vectors.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries)
    chosen = vectors.join(F.broadcast(ids.toDF("_id")), F.col("id").eqNullSafe(F.col("_id")))
    rows = chosen.groupBy("id").agg(F.min("x").alias("x")).orderBy(F.asc_nulls_last("id")).collect()
    if not rows:
        return None
    matrix = np.array([r["x"] for r in rows], np.int64)
    if matrix.shape[1] % parts:
        raise ValueError(f"vectors of {matrix.shape[1]} components cannot be cut into {parts} equal parts")
    return Codebooks(matrix.reshape(len(matrix), parts, -1).transpose(1, 0, 2).copy())


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.entries.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = books.lists()
        totals = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = integer_matrix(batch.column(0))
                codes, _ = books.nearest(rows, lists)
                cuts = rows.reshape(len(rows), parts, width)
                for p in range(parts):
                    np.add.at(totals[p], codes[:, p], cuts[:, p])
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(counts > 0)
        for p, e in used.tolist():
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([p] * width, pa.int32()), "entry": pa.array([e] * width, pa.int32()),
                 "place": pa.array(range(width), pa.int32()), "total": pa.array(totals[p, e]),
                 "n": pa.array([int(counts[p, e])] * width, pa.int64())}
            )

    sums = vectors.select("x").mapInArrow(task, "part int, entry int, place int, total long, n long")
    fresh = books.entries.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect():
        fresh[r["part"], r["entry"], r["place"]] = r["t"] // r["n"]
    return Codebooks(fresh)


def train_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks of ``vectors`` (id, x) after ``rounds`` rounds; None for no vectors."""
    if entries > 256:
        raise ValueError("an index has two hex digits, so a codebook has at most 256 entries")
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, other columns, code, error) of ``vectors`` (id, x, other columns)."""
    kept = [name for name in vectors.columns if name != "x"]
    schema = T.StructType([vectors.schema[name] for name in kept]).add("code", "string").add("error", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = books.lists()
        for batch in batches:
            if batch.num_rows:
                codes, gaps = books.nearest(integer_matrix(batch.column("x")), lists)
                arrays = {name: batch.column(name) for name in kept}
                arrays["code"] = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
                arrays["error"] = pa.array(gaps.sum(axis=1))
                yield pa.RecordBatch.from_pydict(arrays)

    return vectors.mapInArrow(task, schema)


def compress_vectors(
    rows: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label: Column | None = None,
    broadcast_labels: int = BROADCAST_LABELS,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, code, error, label_error) for each usable row, and the codebooks.

    ``label``: rows of equal value, nulls together, share ``label_error``, the sum of their errors.
    """
    vectors = usable_vectors(
        rows, scale, id_column, vector_column, label=F.lit(None).cast("int") if label is None else label
    )
    books = train_codebooks(vectors, parts, entries, rounds)
    if books is None:
        empty = "id long, code string, error long, label_error long"
        return rows.sparkSession.createDataFrame([], empty), None
    coded = cut(encode(vectors, books))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    side = F.broadcast(sums) if fits_broadcast(sums, broadcast_labels) else sums
    found = coded.join(side, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("id", "code", "error", "label_error"), books
