"""Ledger appends from a stream, one signed batch per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from attestra.sources.ledger_store import LedgerStore


def append_stream(
    inputs: DataFrame, store: LedgerStore, order: list[str], checkpoint: str
) -> DataStreamWriter:
    """A writer that appends every micro-batch under its own number.

    A micro-batch that is retried after its commit is left as it is, one that failed before it is
    staged anew, so each input row is chained exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, order, batch=number)

    return inputs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
