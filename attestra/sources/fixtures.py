"""Hand-chunked markdown: text between chunk markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T

CHUNK_MARKER = r"<!--\s*chunk:([A-Za-z0-9_-]+)\s*-->"


def parse_fixture_chunks(files: DataFrame, marker: str = CHUNK_MARKER) -> DataFrame:
    """``source_path, chunk_index, chunk_id, chunk_text`` from ``source_path, text``."""
    pieces = F.zip_with(
        F.regexp_extract_all("text", F.lit(marker), F.lit(1)),
        F.slice(F.split("text", marker), F.lit(2), F.lit(2**30)),
        lambda name, body: F.struct(
            name.alias("chunk_id"), T.trim_unicode(body).alias("chunk_text")
        ),
    )
    return files.select("source_path", F.posexplode(pieces).alias("chunk_index", "c")).select(
        "source_path", "chunk_index", "c.chunk_id", "c.chunk_text"
    )


def duplicate_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def load_fixture_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """All marked chunks below a directory; an id used twice, in or across files, is an error."""
    files = spark.read.text(
        directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md"
    ).select(F.input_file_name().alias("source_path"), F.col("value").alias("text"))
    chunks = parse_fixture_chunks(files)
    repeated = duplicate_chunk_ids(chunks).first()
    if repeated:
        raise ValueError(f"Duplicate chunk id: {repeated['chunk_id']}")
    return chunks
