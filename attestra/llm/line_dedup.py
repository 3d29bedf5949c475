"""Lines that several documents share.

Normalised lines are exploded and hashed, distinct documents are counted for each hash, lines over
the threshold go from all documents but the first, and texts are put together again by position.
Only hashes are grouped; a text moves once, to meet the hashes its document loses.

Defined results: a null or empty text is one empty line. A line shorter than ``min_chars`` code
points after normalisation always stays. Rows that repeat an id count as one document and keep or
lose the same lines. A row with a null id holds no lines for the count and stays whole. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import cut, id_and_text, small_batches, text_slices

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the normalised line, or None for a line that is too short to judge."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def explode_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row (h1, h2, id) for each distinct key of each document row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            digests, ids = [], []
            for owner, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    continue
                keys = {line_key(line, min_chars) for line in text.encode().split(b"\n")} - {None}
                digests += keys
                ids += [owner] * len(keys)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())],
                ["h1", "h2", "id"],
            )

    return docs.filter(F.col("id").isNotNull()).mapInArrow(task, "h1 long, h2 long, id long")


def lost_lines(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(id, keys): the key hashes a document loses, as one array of 16-byte values."""
    lines = explode_lines(docs, min_chars)
    seen = [F.min("id").alias("first_id"), F.max("id").alias("last_id")]
    if min_documents > 2:
        seen.append(F.count_distinct("id").alias("n"))
    shared = lines.groupBy("h1", "h2").agg(*seen).filter(F.col("first_id") < F.col("last_id"))
    if min_documents > 2:
        shared = shared.filter(F.col("n") >= min_documents)
    return (
        lines.join(cut(shared.select("h1", "h2", "first_id")), ["h1", "h2"])
        .filter(F.col("id") > F.col("first_id"))
        .groupBy("id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))
    )


def drop_lines(
    docs: DataFrame, id_column: str, text_column: str, min_chars: int, min_documents: int, counted: bool
) -> DataFrame:
    """``docs`` with the lines that stay as its text, and with n_lines and n_dropped if ``counted``."""
    small_batches(docs.sparkSession)
    lost = lost_lines(id_and_text(docs, id_column, text_column), min_chars, min_documents)
    lost = lost.select(F.col("id").alias("_lost_id"), F.col("keys").alias("_lost_keys"))
    columns = docs.columns
    schema = T.StructType(list(docs.schema))
    if counted:
        schema = schema.add("n_lines", "long").add("n_dropped", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column):
            texts, totals, dropped = [], [], []
            for text, keys in zip(batch.column(text_column).to_pylist(), batch.column("_lost_keys")):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if keys.is_valid:
                    pairs = keys.values
                    halves = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], 1)
                    gone = halves.astype(">i8").tobytes()
                    gone = {gone[i : i + 16] for i in range(0, len(gone), 16)}
                    kept = [line for line in lines if line_key(line, min_chars) not in gone]
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            arrays = {name: batch.column(name) for name in columns}
            arrays[text_column] = pa.array(texts, pa.string())
            if counted:
                arrays |= {"n_lines": pa.array(totals, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(arrays)

    meets = F.col(id_column).cast("long") == F.col("_lost_id")
    return docs.join(lost.hint("shuffle_hash"), meets, "left").mapInArrow(task, schema)


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 10,
    min_documents: int = 2,
) -> DataFrame:
    """One row per document row: id, text (the lines that stay; null texts stay null), n_lines,
    n_dropped."""
    return drop_lines(id_and_text(docs, id_column, text_column), "id", "text", min_chars, min_documents, True)


def without_shared_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 10,
    min_documents: int = 2,
) -> DataFrame:
    """``docs`` with all its columns, the text holding the lines that stay."""
    return drop_lines(docs, id_column, text_column, min_chars, min_documents, False)
