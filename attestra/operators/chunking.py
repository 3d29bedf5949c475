"""Overlapping token windows and the chunk records built from them.

Input is a *revisions* frame: ``source_path, source_type, content_sha256, text, ocr_used, warnings``.
All windows of a document are built inside one row and exploded once, so there is no shuffle here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import hashing, text as T

# Window defaults and the version string recorded with every snapshot.
DEFAULT_WINDOW = 800
DEFAULT_OVERLAP = 100
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
CHUNKER_VERSION = "chunker-800-100-v1"


def window_starts(token_count: Column, window: int, overlap: int) -> Column:
    """Start offsets; the first window that reaches the end is the last one, no token gives none."""
    step = max(1, window - overlap)
    beyond = F.greatest(token_count - F.lit(window), F.lit(0))
    last = F.ceil(beyond / F.lit(step)).cast("int")
    count = F.when(token_count > 0, last + 1).otherwise(F.lit(0))
    return F.transform(
        F.slice(F.sequence(F.lit(0), last), F.lit(1), count), lambda i: (i * step).cast("int")
    )


def revisions_from_documents(documents: DataFrame, source_type: str = "markdown") -> DataFrame:
    """View a documents table (``doc_id, source, text``) as document revisions."""
    return documents.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"),
        F.lit(source_type).alias("source_type"),
        hashing.sha256_hex(F.col("text")).alias("content_sha256"),
        T.normalize_text(F.col("text")).alias("text"),
        T.scanned_pdf(F.col("text"), F.lit(source_type)).alias("ocr_used"),
        T.extraction_warnings(F.col("text"), F.lit(source_type)).alias("warnings"),
    )


def token_windows(
    revisions: DataFrame,
    window: int = DEFAULT_WINDOW,
    overlap: int = DEFAULT_OVERLAP,
) -> DataFrame:
    """One row per window: the revision's columns (without text) plus index, bounds and text."""
    keep = [c for c in revisions.columns if c != "text"]
    tokens = F.col("_tokens")
    windows = F.transform(
        window_starts(F.size(tokens), window, overlap),
        lambda start, i: F.struct(
            i.cast("int").alias("chunk_index"),
            start.alias("token_start"),
            F.least(start + window, F.size(tokens)).alias("token_end"),
            F.array_join(F.slice(tokens, start + 1, F.lit(window)), " ").alias("chunk_text"),
        ),
    )
    return (
        revisions.select(*keep, T.whitespace_tokens(F.col("text")).alias("_tokens"))
        .select(*keep, F.inline(windows))
    )


def token_windows_with_offsets(
    revisions: DataFrame,
    window: int = DEFAULT_WINDOW,
    overlap: int = DEFAULT_OVERLAP,
) -> DataFrame:
    """``token_windows`` plus character range.

    The range is the first verbatim occurrence of the window's text; where single blanks do not
    reproduce the source, it is the range from the first to the last token of the window.
    """
    keep = [c for c in revisions.columns if c != "text"]
    text, tokens, gaps = F.col("text"), F.col("_tokens"), F.col("_gaps")

    # Only text with astral characters needs counting in UTF-16 units; one scan per document tells.
    astral = F.col("_astral")

    def units(part: Column) -> Column:
        return F.when(astral, T.utf16_length(part)).otherwise(F.length(part))

    def span(prefix: Column) -> Column:
        return units(F.array_join(prefix, ""))

    def token_start(index: Column) -> Column:
        return span(F.slice(gaps, F.lit(1), index + 1)) + span(F.slice(tokens, F.lit(1), index))

    def token_end(index: Column) -> Column:
        return span(F.slice(gaps, F.lit(1), index)) + span(F.slice(tokens, F.lit(1), index))

    def before(count: Column) -> Column:
        return F.when(astral, T.utf16_length(F.substring(text, F.lit(1), count))).otherwise(count)

    bare = F.transform(
        window_starts(F.size(tokens), window, overlap),
        lambda start, i: F.struct(
            i.cast("int").alias("chunk_index"),
            start.alias("token_start"),
            F.least(start + window, F.size(tokens)).alias("token_end"),
            F.array_join(F.slice(tokens, start + 1, F.lit(window)), " ").alias("chunk_text"),
        ),
    )
    located = F.transform(
        F.col("_windows"),
        lambda w: F.struct(
            w["chunk_index"].alias("chunk_index"),
            w["token_start"].alias("token_start"),
            w["token_end"].alias("token_end"),
            w["chunk_text"].alias("chunk_text"),
            F.position(w["chunk_text"], text).alias("_at"),
        ),
    )
    ranged = F.transform(
        F.col("_located"),
        lambda w: F.struct(
            w["chunk_index"].alias("chunk_index"),
            w["token_start"].alias("token_start"),
            w["token_end"].alias("token_end"),
            F.when(w["_at"] > 0, before(w["_at"] - 1))
            .otherwise(token_start(w["token_start"]))
            .cast("int")
            .alias("char_start"),
            F.when(w["_at"] > 0, before(w["_at"] - 1 + F.length(w["chunk_text"])))
            .otherwise(token_end(w["token_end"]))
            .cast("int")
            .alias("char_end"),
            w["chunk_text"].alias("chunk_text"),
        ),
    )
    return (
        revisions.withColumn("_tokens", T.whitespace_tokens(text))
        .withColumn("_astral", text.rlike(ASTRAL))
        .withColumn("_windows", bare)
        .withColumn("_located", located)
        # Gaps only matter where some window is not found verbatim.
        .withColumn("_lost", F.exists("_located", lambda w: w["_at"] == 0))
        .withColumn("_gaps", F.when(F.col("_lost"), F.split(T.plain_blanks(text), r"\S+")))
        .select(*keep, F.inline(ranged))
    )


def chunk_id(snapshot_id: Column) -> Column:
    return hashing.stable_id(
        "chunk",
        snapshot_id,
        F.col("source_path"),
        F.col("chunk_index"),
        F.col("chunk_sha256"),
    )


def chunk_keys(windows: DataFrame, snapshot_id: Column) -> DataFrame:
    """The columns ranking needs; wide record columns stay out of the plan."""
    return windows.select(
        "source_path", "chunk_index", "chunk_text",
        hashing.sha256_hex(F.col("chunk_text")).alias("chunk_sha256"),
        snapshot_id.alias("corpus_snapshot_id"),
    ).withColumn("chunk_id", chunk_id(F.col("corpus_snapshot_id")))


def chunk_records(windows: DataFrame, snapshot_id: Column, snapshot_hash: Column) -> DataFrame:
    """Full chunk records from ``token_windows_with_offsets``."""
    return (
        windows.withColumn("chunk_sha256", hashing.sha256_hex(F.col("chunk_text")))
        .withColumn("corpus_snapshot_id", snapshot_id)
        .select(
            chunk_id(F.col("corpus_snapshot_id")).alias("chunk_id"),
            hashing.stable_id("doc", F.col("source_path")).alias("doc_id"),
            hashing.stable_id("src", F.col("source_path")).alias("source_document_id"),
            "source_type",
            "source_path",
            F.lit(1).alias("page_start"),
            F.lit(1).alias("page_end"),
            "char_start",
            "char_end",
            "token_start",
            "token_end",
            "chunk_index",
            "chunk_text",
            "chunk_sha256",
            "corpus_snapshot_id",
            snapshot_hash.alias("corpus_snapshot_hash"),
            F.col("warnings").alias("extraction_warnings"),
            "ocr_used",
        )
    )
