"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, so that long texts fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for a while and are then what they were."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpoint_directory(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only in local mode, where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="attestra-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write a small result that several branches read, so it is computed once and survives
    the loss of executors."""
    checkpoint_directory(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored_once(frame: DataFrame) -> DataFrame:
    """Write a result as large as its input for the passes of several jobs, which then read only the
    columns they need. Exchanges are shared within one job at most."""
    path = f"{checkpoint_directory(frame.sparkSession)}/once-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
