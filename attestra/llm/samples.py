"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 1 << 30


def bounded_sample(rows: DataFrame, label: str, per_label: dict | int) -> DataFrame:
    """About ``per_label`` rows (id, label) of each label, chosen by a hash of the id.

    Counts cover all rows; a label's share follows from its count, so no label is sorted or met in
    one task. The number of labels has to be small (classes). The result is cut at twice the sum.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    kept, most = F.lit(False), 0
    for value, count in sorted(counts.items(), key=str):
        wanted = per_label if isinstance(per_label, int) else per_label.get(value, 0)
        most += wanted
        share = min(HASH_RANGE, wanted * HASH_RANGE // max(count, 1))
        spot = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(HASH_RANGE))
        kept = kept | ((F.col(label) == F.lit(value)) & (spot < share))
    return rows.filter(kept).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(2 * max(most, 1))


def with_texts(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of sampled ids; the sample's documented bound allows the broadcast."""
    return docs.join(F.broadcast(chosen), "id")


def fit_in_task(sample: DataFrame, fit: Callable[[dict[str, list]], Any]) -> Any:
    """``fit`` applied to the columns of a bounded sample, ordered by id, in one task; only what it
    returns, plain values and arrays, comes back to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {name: [] for name in names}
        for batch in batches:
            for name in names:
                columns[name] += batch.column(name).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(columns))], pa.binary())], ["model"])

    names = sample.columns
    ordered = sample.repartition(1).sortWithinPartitions("id")
    row = ordered.mapInArrow(task, "model binary").first()
    # An empty sample has no task.
    return fit({name: [] for name in names}) if row is None else pickle.loads(row[0])
