"""Parquet tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Below this much input per core the file layout, not the cluster, decides how many tasks work.
SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024


def path_bytes(spark: SparkSession, path: str) -> int:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(jvm_path).getLength()


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_text_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are expensive to parse.

    A small file holds one row group and would be parsed by one task, so it is spread over the
    cores. Large inputs already split by row group and are never shuffled here.
    """
    frame = read_table(spark, directory, name)
    if columns:
        frame = frame.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if path_bytes(spark, f"{directory}/{name}.parquet") < SPREAD_BYTES_PER_CORE * cores:
        frame = frame.repartition(cores)
    return frame
