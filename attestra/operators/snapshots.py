"""Corpus snapshots: identity, change detection and ingest results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from attestra.domain import DEFAULT_EMBEDDING_MODEL
from attestra.functions import canonical_json as J
from attestra.functions import hashing, text as T
from attestra.functions.vector import estimated_index_bytes
from attestra.operators.chunking import (
    CHUNKER_VERSION,
    DEFAULT_OVERLAP,
    DEFAULT_WINDOW,
    window_starts,
)
from attestra.session import small_batches

TREE, FLAT = "tree", "flat"
# The tree's leaves: documents by the first digits of their path's hash, 65,536 at every size.
DIGEST_BUCKET_DIGITS = 4
TOKENS = "n_tokens"


def _ordered_digest(path: Column, digest: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(path.alias("p"), digest.alias("d"))))
    return hashing.sha256_hex(F.array_join(F.transform(ordered, lambda x: x["d"]), "|"))


def tree_digest(keyed: DataFrame) -> DataFrame:
    """``base_hash`` of ``key, digest``: a hash per bucket of keys, then one over the buckets."""
    bucket = F.substring(F.sha2("key", 256), 1, DIGEST_BUCKET_DIGITS)
    leaves = keyed.groupBy(bucket.alias("bucket")).agg(
        _ordered_digest(F.col("key"), F.col("digest")).alias("leaf")
    )
    return leaves.agg(_ordered_digest(F.col("bucket"), F.col("leaf")).alias("base_hash"))


def _streamed_hash(parts: DataFrame, head: str, separator: str, tail: str) -> DataFrame:
    """``base_hash`` over the column ``part`` in order of ``key``, streamed with constant state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = hashlib.sha256(head.encode()), True
        for batch in batches:
            for part in batch.column("part").to_pylist():
                state.update((part if first else separator + part).encode())
                first = False
        state.update(tail.encode())
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["base_hash"])

    ordered = parts.repartition(1).sortWithinPartitions("key")
    return ordered.select("part").mapInArrow(run, "base_hash string")


def _known_kind(kind: str) -> str:
    if kind not in (TREE, FLAT):
        raise ValueError(f"unknown digest kind {kind!r}")
    return kind


def corpus_digest(revisions: DataFrame, kind: str = TREE) -> DataFrame:
    """One row ``base_hash, digest_kind`` over the content hashes in path order.

    The kind is chosen by the caller and never by the size of the corpus. ``tree`` hashes within
    buckets of the path's hash and then over the bucket digests, in parallel. ``flat`` is one hash
    over all content hashes; it is sequential, so one task streams them in path order.
    """
    keyed = revisions.select(
        F.col("source_path").alias("key"), F.col("content_sha256").alias("digest")
    )
    if _known_kind(kind) == TREE:
        digest = tree_digest(keyed)
    else:
        digest = _streamed_hash(keyed.withColumnRenamed("digest", "part"), "", "|", "")
    return digest.withColumn("digest_kind", F.lit(kind))


def token_count(text: Column) -> Column:
    """The number of ``whitespace_tokens``, without an array of them."""
    return F.regexp_count(T.plain_blanks(text), F.lit(r"\S+"))


def counted_tokens(text: Column) -> Column:
    """``token_count`` over Arrow batches, for passes that store the text."""
    small_batches(SparkSession.getActiveSession())

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([_tokens_in(t) for t in texts], pa.int32())

    return count(text)


def _tokens_in(text: pa.Scalar) -> int | None:
    if not text.is_valid:
        return None
    data = np.frombuffer(text.as_buffer(), np.uint8)
    if len(data) and data.max() > 127:
        plain = re.sub(T.WIDE_BLANKS, " ", text.as_py())
        data = np.frombuffer(plain.encode(), np.uint8)
    # ASCII blanks are 9 to 13 and 32.
    solid = (data - np.uint8(9) > 4) & (data != 32)
    return int(np.count_nonzero(solid[1:] & ~solid[:-1]) + (len(solid) > 0 and solid[0]))


def _windows_of(tokens: Column, window: int, overlap: int) -> Column:
    return F.size(window_starts(tokens, window, overlap))


def window_count(text: Column, window: int, overlap: int) -> Column:
    return _windows_of(token_count(text), window, overlap)


def revision_windows(revisions: DataFrame, window: int, overlap: int) -> Column:
    """Windows of each revision; tokens a revision carries as ``TOKENS`` are not counted again."""
    if TOKENS in revisions.columns:
        return _windows_of(F.col(TOKENS), window, overlap)
    return window_count(F.col("text"), window, overlap)


def snapshot_id(sequence: Column, base_hash: Column) -> Column:
    return hashing.stable_id("snap", sequence, base_hash)


def snapshot_hash(base_hash: Column, chunk_count: Column) -> Column:
    counted = hashing.sha256_hex(F.concat_ws(":", base_hash, chunk_count.cast("string")))
    return F.when(chunk_count == 0, base_hash).otherwise(counted)


def snapshot_row(
    revisions: DataFrame,
    sequence: int,
    status: str = "active",
    window: int = DEFAULT_WINDOW,
    overlap: int = DEFAULT_OVERLAP,
    kind: str = TREE,
    counted: tuple[int, int] | None = None,
) -> DataFrame:
    """The snapshot a set of revisions would become; ``counted``: documents and chunks, if known."""
    if counted is None:
        counts = revisions.agg(
            F.count(F.lit(1)).alias("document_count"),
            F.coalesce(F.sum(revision_windows(revisions, window, overlap)), F.lit(0))
            .cast("bigint")
            .alias("chunk_count"),
        )
        documents, chunks = counts.select("document_count").scalar(), counts.select("chunk_count").scalar()
    else:
        documents, chunks = (F.lit(n).cast("bigint") for n in counted)
    digest = corpus_digest(revisions, kind)
    base, number = F.col("base_hash"), F.lit(sequence)
    return digest.select(
        "base_hash",
        "digest_kind",
        documents.alias("document_count"),
        chunks.alias("chunk_count"),
    ).select(
        snapshot_id(number, base).alias("id"),
        number.alias("sequence"),
        snapshot_hash(base, F.col("chunk_count")).alias("snapshot_hash"),
        "base_hash",
        F.lit(DEFAULT_EMBEDDING_MODEL).alias("embedding_model_version"),
        F.lit(CHUNKER_VERSION).alias("chunker_version"),
        F.lit(status).alias("status"),
        "document_count",
        "chunk_count",
        "digest_kind",
    )


def active_snapshot(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot with status active; earlier ones stay active but are not served."""
    return snapshots.filter(F.col("status") == "active").orderBy(F.col("sequence").desc()).limit(1)


def next_sequence(snapshots: DataFrame) -> DataFrame:
    highest = F.coalesce(F.max("sequence"), F.lit(0))
    return snapshots.agg((highest + 1).cast("int").alias("next_sequence"))


def changed_revisions(revisions: DataFrame, stored: DataFrame) -> DataFrame:
    """Revisions whose stored hash is missing or different; deletions alone change nothing."""
    known = stored.select("source_path", F.col("content_sha256").alias("_stored_sha256"))
    return (
        revisions.join(known, "source_path", "left")
        .filter(~F.col("_stored_sha256").eqNullSafe(F.col("content_sha256")))
        .drop("_stored_sha256")
    )


def ingest_summary(
    revisions: DataFrame,
    stored: DataFrame,
    dry_run: bool = False,
    failed: bool = False,
    window: int = DEFAULT_WINDOW,
    overlap: int = DEFAULT_OVERLAP,
) -> DataFrame:
    """One row with the outcome an ingest of these revisions has, computed in one pass."""
    known = stored.select("source_path", F.col("content_sha256").alias("_stored_sha256"))
    changed = ~F.col("_stored_sha256").eqNullSafe(F.col("content_sha256"))
    counted = revisions.join(known, "source_path", "left").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count(F.when(changed, 1)).alias("changed_document_count"),
        F.coalesce(F.sum(revision_windows(revisions, window, overlap)), F.lit(0))
        .cast("bigint")
        .alias("_chunks"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("warning_count"),
    )
    unchanged = F.col("changed_document_count") == 0
    idle = unchanged & F.lit(not dry_run)
    chunks = F.when(idle, F.lit(0)).otherwise(F.col("_chunks")).cast("bigint")
    return counted.select(
        F.lit(dry_run).alias("dry_run"),
        "document_count",
        "changed_document_count",
        chunks.alias("chunk_count"),
        estimated_index_bytes(chunks).alias("estimated_index_bytes"),
        "warning_count",
        (~unchanged & F.lit(not dry_run and not failed)).alias("activated"),
        unchanged.alias("no_op"),
    )


# The event an ingest leaves in the ledger.
INGEST_EVENT, INGEST_OUTCOME = "corpus.ingest.completed", "corpus-ingest-completed"
INGEST_USER = "system-ingest"


def ingest_events(snapshot: DataFrame, ledger_id: Column, timestamp_ms: Column) -> DataFrame:
    """Ledger inputs of activated snapshots (rows of ``snapshot_row``): which snapshot, how large."""
    counts = {"chunkCount": F.col("chunk_count"), "documentCount": F.col("document_count")}
    return snapshot.select(
        ledger_id.alias("ledger_id"),
        F.col("sequence").alias("append_order"),
        F.lit(INGEST_EVENT).alias("entry_type"),
        F.lit(INGEST_OUTCOME).alias("outcome"),
        F.lit(DEFAULT_EMBEDDING_MODEL).alias("embedding_model_version"),
        F.col("id").alias("corpus_snapshot_id"),
        F.col("snapshot_hash").alias("corpus_snapshot_hash"),
        hashing.sha256_hex(F.lit(INGEST_USER)).alias("user_id_hash"),
        timestamp_ms.cast("bigint").alias("timestamp_ms"),
        J.json_object({k: J.json_integer(v) for k, v in counts.items()}).alias("metadata"),
    )


def fixture_corpus_hash(chunks: DataFrame, kind: str = TREE) -> DataFrame:
    """Hash of a hand-chunked corpus: canonical manifest of (chunk id, text hash) and count.

    It digests the text that is served, not a stored hash column, and also moves on a renamed id.
    ``flat`` streams the manifest's entries in order through one hash; ``tree`` puts a digest over
    buckets of the chunk id in place of the list of entries.
    """
    text_hash = F.sha2("chunk_text", 256)
    entry = J.lower_escapes(
        J.json_object(
            {"chunkId": J.json_string(F.col("chunk_id")), "textSha256": J.json_string(text_hash)}
        )
    )
    if _known_kind(kind) == FLAT:
        count = chunks.count()
        parts = chunks.select(entry.alias("key"), entry.alias("part"))
        hashed = _streamed_hash(parts, f'{{"chunkCount":{count},"chunks":[', ",", "]}")
        return hashed.withColumnRenamed("base_hash", "corpus_hash")
    keyed = chunks.select(F.col("chunk_id").alias("key"), F.sha2(entry, 256).alias("digest"))
    count = chunks.agg(F.count(F.lit(1)).cast("string").alias("n")).scalar()
    manifest = F.concat(F.lit('{"chunkCount":'), count, F.lit(',"chunks":"'), "base_hash", F.lit('"}'))
    return tree_digest(keyed).select(hashing.sha256_hex(manifest).alias("corpus_hash"))


def provenance(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether each source consists of its chunks, verbatim and in order.

    ``sources``: ``source_id, text``; ``chunks``: ``source_id, chunk_index, chunk_text``. Between
    chunks only ``(n)`` markers and blanks may remain. Chunks are gathered per source document.
    """
    listed = chunks.groupBy("source_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))),
            lambda c: c["chunk_text"],
        ).alias("parts")
    )
    start = F.struct(F.lit(1).alias("cursor"), F.lit("").alias("left"), F.lit(0).alias("missing"))

    def step(state: Column, part: Column) -> Column:
        at = F.position(part, F.col("text"), state["cursor"])
        return F.struct(
            F.when(at > 0, at + F.length(part)).otherwise(state["cursor"]).alias("cursor"),
            F.when(
                at > 0,
                F.concat(
                    state["left"],
                    F.substring(F.col("text"), state["cursor"], at - state["cursor"]),
                    F.lit(" "),
                ),
            ).otherwise(state["left"]).alias("left"),
            (state["missing"] + F.when(at > 0, F.lit(0)).otherwise(F.lit(1))).alias("missing"),
        )

    folded = F.aggregate("parts", start, step)
    joined = sources.join(listed, "source_id", "left").withColumn("_f", folded)
    rest = F.concat(
        F.col("_f.left"), F.substring("text", F.col("_f.cursor"), F.length("text"))
    )
    remainder = F.regexp_replace(rest, rf"\([0-9]+\)|{T.WHITESPACE}+", "")
    return joined.select(
        "source_id",
        F.coalesce(F.size("parts"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.col("_f.missing"), F.lit(0)).alias("n_missing"),
        (F.coalesce(F.col("_f.missing") == 0, F.lit(False)) & (remainder == "")).alias("verbatim"),
    )


def pinned_sources(sources: DataFrame) -> DataFrame:
    """Whether each source still is what was retrieved: its text's hash is the recorded one, its
    address is an https one and the day of retrieval is a date.

    ``sources``: ``source_id, text, recorded_sha256, retrieval_url, retrieved_at``.
    """
    same = (F.sha2("text", 256) == F.col("recorded_sha256")).alias("same_text")
    secure = F.col("retrieval_url").rlike("^https://").alias("secure_url")
    dated = F.col("retrieved_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("dated")
    flags = sources.select("source_id", *[F.coalesce(c, F.lit(False)).alias(n) for c, n in (
        (same, "same_text"), (secure, "secure_url"), (dated, "dated"))])
    return flags.withColumn("pinned", F.col("same_text") & F.col("secure_url") & F.col("dated"))
