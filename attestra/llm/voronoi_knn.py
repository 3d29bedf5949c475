"""Exact k nearest neighbours by inner product: a Voronoi join.

Every vector belongs to the cell of its nearest pivot. Summaries of the cells (rows, largest distance
to the pivot) bound what a query can find there: ``q.p + |q| * r`` from above, ``q.p - |q| * r`` from
below. The bounds, with the scores of the pivots themselves, give a score each query surely reaches
k times; cells that cannot reach it are not visited. Queries are grouped by their own cell, small groups
of neighbouring cells together, and a cell's rows go only to groups that need them. Cells are cut into blocks of at most ``BLOCK`` rows and
groups into chunks, so copies of one vector never meet in one task; block results are merged.

Components become integers, so scores and ties are exact. Defined results: rows with a null id, a
null vector or a null or non-finite component take no part; nor do vectors of another length than a
query's, for that query. Rows sharing a query's id are its own. If a query id repeats, the smallest of
its vectors asks. Queries without any candidate give no row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import cut

PIVOTS = 64
BLOCK = 4096
CHUNK = 1024


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in floating point where no sum can leave 2^53."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if largest * left.shape[1] < 2**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v): vectors of integers, unusable rows left out."""
    element = F.transform(vector_column, lambda x: x.cast("double"))
    kept = rows.select(F.col(id_column).cast("long").alias("id"), element.alias("x")).filter(
        F.col("id").isNotNull()
        & F.col("x").isNotNull()
        & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (F.size("x") > 0)
    )
    return kept.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def assign_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, distance): the nearest pivot and the distance to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.astype(float)
        squares = (points**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("v")).astype(float)
            gaps = np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ points.T + squares, 0)
            cell = gaps.argmin(axis=1)
            distance = np.sqrt(gaps[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(distance)],
                ["id", "v", "cell", "distance"],
            )

    return vectors.mapInArrow(task, "id long, v array<long>, cell int, distance double")


def needed_cells(queries: DataFrame, pivot_ids: np.ndarray, pivots: np.ndarray, cells: dict, k: int) -> DataFrame:
    """(id, v, cell, cells): the cells that can hold one of a query's k best."""
    numbers = np.array(sorted(cells))
    counts = np.array([cells[c][0] for c in numbers])
    # A little more than the computed radius, as distances are rounded.
    radius = np.array([cells[c][1] for c in numbers]) * (1 + 1e-9) + 1e-6

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            rows = matrix(batch.column("v"))
            exact = products(rows, pivots)
            near = exact[:, numbers].astype(float)
            reach = np.linalg.norm(rows, axis=1)[:, None] * radius
            low, high = near - reach, near + reach
            # k rows besides the query's own surely score at least ``floor``.
            order = np.argsort(-low, axis=1)
            held = np.cumsum(counts[order], axis=1)
            enough = held >= k + 1
            at = enough.argmax(axis=1)
            floor = np.where(
                enough.any(axis=1), low[np.arange(len(rows)), order[np.arange(len(rows)), at]], -np.inf
            )
            others = np.where(pivot_ids[None, :] == ids[:, None], -np.inf, exact.astype(float))
            if others.shape[1] >= k + 1:
                floor = np.maximum(floor, np.sort(others, axis=1)[:, -k])
            wanted = [numbers[row].tolist() for row in high >= floor[:, None] - 1e-6]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), batch.column("cell"), pa.array(wanted, pa.list_(pa.int32()))],
                ["id", "v", "cell", "cells"],
            )

    return queries.select("id", "v", "cell").mapInArrow(task, "id long, v array<long>, cell int, cells array<int>")


def packed_homes(counts: dict[int, int], points: np.ndarray, most: int) -> dict[int, int]:
    """Home cells to groups of about ``most`` queries; neighbours come after each other, as they need
    much the same cells, so that those are sent once for all of them."""
    rest = sorted(counts)
    chain = [rest.pop(0)] if rest else []
    while rest:
        gaps = ((points[rest] - points[chain[-1]]).astype(float) ** 2).sum(axis=1)
        chain.append(rest.pop(int(gaps.argmin())))
    found, group, held = {}, 0, 0
    for home in chain:
        if held and held + counts[home] > most:
            group, held = group + 1, 0
        found[home] = group
        held += counts[home]
    return found


def best_in_block(k: int):
    def solve(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        queries, ids = [], []
        found: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            asked, held = asked.combine_chunks(), held.combine_chunks().sort_by("id")
            queries, ids = asked["id"].to_numpy(), held["id"].to_numpy()
            scores = products(matrix(asked["v"].chunk(0)), matrix(held["v"].chunk(0)))
            for query, row in zip(queries, scores):
                usable = np.flatnonzero(ids != query)
                values = row[usable]
                if len(values) > k:
                    least = np.partition(values, len(values) - k)[len(values) - k]
                    usable = usable[values >= least]
                best = usable[np.argsort(-row[usable], kind="stable")[:k]]
                found[0] += [query] * len(best)
                found[1] += ids[best].tolist()
                found[2] += row[best].tolist()
        return pa.table(
            {name: pa.array(values, pa.int64()) for name, values in zip(("query_id", "vec_id", "score"), found)}
        )

    return solve


def knn_join(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query. ``is_query`` is a condition
    over the column ``id``."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score long"
    vectors = integer_vectors(rows, id_column, vector_column, scale)
    results = None
    for (size,) in vectors.select(F.size("v")).distinct().collect():
        alike = vectors.filter(F.size("v") == size)
        # Distinct vectors make distinct pivots; the sample's size is a parameter.
        sample = (
            alike.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        )
        points = np.array([r.v for r in sample], np.int64)
        data = cut(assign_cells(alike, points))
        cells = {
            r.cell: (r.n, r.r)
            for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()
        }
        queries = data.filter(is_query).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q"))
        queries = queries.select("id", "q.v", "q.cell")
        asked = cut(needed_cells(queries, np.array([r.id for r in sample]), points, cells, k))
        groups = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}

        def pieces(counts: dict[int, int], most: int) -> Column:
            """In how many parts a cell is cut, as an expression over the column ``cell``."""
            shares = [F.lit(x) for c, n in sorted(counts.items()) for x in (c, -(-n // most))]
            return F.create_map(*shares)[F.col("cell")] if shares else F.lit(1)

        homes = packed_homes(groups, points, CHUNK)
        packs: dict[int, int] = {}
        for home, pack in homes.items():
            packs[pack] = packs.get(pack, 0) + groups[home]
        if homes:
            pairs = [F.lit(x) for pair in sorted(homes.items()) for x in pair]
            asked = asked.withColumn("cell", F.create_map(*pairs)[F.col("cell")])
        spot = F.xxhash64("id", F.lit(23))
        data = data.select("id", "v", "cell", F.pmod(spot, pieces({c: n for c, (n, _) in cells.items()}, BLOCK)).alias("block"))
        asked = asked.withColumn("part", F.pmod(spot, pieces(packs, CHUNK))).withColumnRenamed("cell", "home")
        asked = asked.select("id", "v", "home", "part", F.explode("cells").alias("cell"))
        blocks = pieces({c: n for c, (n, _) in cells.items()}, BLOCK)
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        keys = ["home", "part", "cell", "block"]
        wanted = asked.select(*[F.col(key).alias(f"for_{key}") for key in keys]).distinct()
        meets = (F.col("cell") == F.col("for_cell")) & (F.col("block") == F.col("for_block"))
        sent = data.join(wanted, meets).select("id", "v", *[f"for_{key}" for key in keys])
        found = (
            asked.groupBy(*keys)
            .cogroup(sent.groupBy(*[f"for_{key}" for key in keys]))
            .applyInArrow(best_in_block(k), schema)
        )
        results = found if results is None else results.unionByName(found)
    if results is None:
        results = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        results.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
