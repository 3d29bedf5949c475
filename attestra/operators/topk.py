"""Top-k per key that stays exact and never sends a whole key to one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(frame: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return frame.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")
    )


def top_k(
    frame: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    name: str = "rank",
    fanout: int = 1,
) -> DataFrame:
    """Keep the first ``k`` rows of each key under a total order.

    The planner already cuts to ``k`` rows per key inside every map task. With very many map tasks
    those survivors still meet in one task per key, so ``fanout`` inserts a round that first cuts
    them within ``fanout`` sub-groups. A row among the best k of its key is among the best k of its
    sub-group, so the result is the same.
    """
    if fanout > 1:
        frame = frame.withColumn(
            "_part", F.pmod(F.spark_partition_id(), F.lit(fanout)).cast("int")
        )
        frame = (
            rank_within(frame, [*keys, "_part"], order, name)
            .filter(F.col(name) <= k)
            .drop(name, "_part")
        )
    return rank_within(frame, keys, order, name).filter(F.col(name) <= k)


def default_fanout(frame: DataFrame) -> int:
    """One extra round only where a key could collect survivors from over a thousand tasks."""
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 if partitions <= 1000 else 64


def fits_broadcast(frame: DataFrame, max_rows: int) -> bool:
    """Whether a side has at most ``max_rows`` rows; counts no further than that."""
    return frame.limit(max_rows + 1).count() <= max_rows


def best_rows(
    scores: np.ndarray, ids: np.ndarray, k: int, rows: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Best k by score, ties by id, with the numbers of the chosen ``rows`` if they are given.

    Only rows at or above the k-th score are sorted. A score that is no number is not ranked.
    """
    number = np.arange(len(scores)) if rows is None else rows
    if np.isnan(scores).any():
        keep = np.flatnonzero(~np.isnan(scores))
        scores, ids, number = scores[keep], ids[keep], number[keep]
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= bar)
        scores, ids, number = scores[keep], ids[keep], number[keep]
    order = np.lexsort((ids, -scores))[:k]
    best = scores[order], ids[order]
    return best if rows is None else (*best, number[order])
