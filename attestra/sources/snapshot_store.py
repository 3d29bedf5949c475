"""Parquet-backed corpus snapshots with stored vectors and postings behind a commit log.

An ingest stages everything in a folder of its attempt: the source, extracted once; chunk records;
their vectors by coarse cell; postings of lexemes with positions by term bucket; frequencies of both. One commit row then makes the snapshot visible. A job that dies before leaves an attempt
nobody reads; of two writers of one sequence number one commits and the other starts again behind it.

Below a snapshot: ``chunks`` (by ``part`` of the chunk id), ``vectors`` (by ``cell``), ``cells``,
``postings`` (by ``bucket`` of the term a lexeme folds into; ``GROUPS`` has the chunks of each group),
``frequencies`` (by ``kind``, terms or lexemes, and ``bucket``), ``lowest`` (the first chunk ids). A posting
packs the chunks of one group that hold a lexeme, as numbers in the group; a frequent term is spread over
several tasks of its bucket. The staged source goes once its snapshot is committed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import chunking, served, snapshots, vector_index
from attestra.operators.embedding import hash_embedding
from attestra.session import settings
from attestra.sources.commit_log import CommitLog, new_attempt, remove_abandoned, remove_attempt
from attestra.sources.tables import SPREAD_BYTES_PER_CORE, path_bytes

if TYPE_CHECKING:
    from attestra.sources.ledger_store import LedgerStore

SNAPSHOT_SCHEMA = (
    "id string, sequence int, snapshot_hash string, base_hash string, "
    "embedding_model_version string, chunker_version string, status string, "
    "document_count bigint, chunk_count bigint, digest_kind string, "
    "attempt string, dimension int, parts int"
)
DOCUMENT_SCHEMA = "source_path string, source_type string, content_sha256 string, sequence int"
CHUNKS_PER_PART = 20_000
MAX_PARTS = 4096
CHUNKS_PER_SALT = 1_000_000
POSTING_ROUNDS = 4  # postings are dealt out in jobs of their own, each with the exchange of its share
LOWEST_IDS = 1000
DEFAULT_DIMENSION = 64
CHUNK_PREFIX = "chunk_"
POSTINGS_SCHEMA = f"{served.GROUP_SCHEMA}, bucket int"
GROUPS = -1  # the bucket of the rows that list the chunks of a group
COMPRESSION = "zstd"
# Files of an exchange go when the job that wrote them ends, not when the driver collects its garbage.
TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FREQUENCIES_SCHEMA = "term string, df bigint, kind string, bucket int"


def default_parts(chunks: int) -> int:
    """A power of two from 8 to ``MAX_PARTS``, one part for ``CHUNKS_PER_PART`` chunks."""
    return min(MAX_PARTS, max(8, 1 << (max(1, chunks // CHUNKS_PER_PART) - 1).bit_length()))


def bucket_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def key_of(chunk_id: Column) -> Column:
    """The hash in a chunk id as 12 bytes; sorts as the id does."""
    return F.unhex(F.substring(chunk_id, len(CHUNK_PREFIX) + 1, 24))


def id_of(key: Column) -> Column:
    return F.concat(F.lit(CHUNK_PREFIX), F.lower(F.hex(key)))


@dataclass(frozen=True)
class IngestResult:
    dry_run: bool
    document_count: int
    changed_document_count: int
    chunk_count: int
    estimated_index_bytes: int
    warning_count: int
    snapshot_id: str | None
    activated: bool
    no_op: bool


@dataclass(frozen=True)
class StoredSnapshot:
    """The tables of one committed snapshot."""

    spark: SparkSession
    path: str
    id: str
    snapshot_hash: str
    chunk_count: int
    dimension: int
    parts: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def chunks(self) -> DataFrame:
        return self.table("chunks").drop("part")

    def vectors(self) -> DataFrame:
        return self.table("vectors").select(id_of(F.col("key")).alias("id"), "vector", "cell")

    def cells(self) -> DataFrame:
        return self.table("cells")

    def lowest(self) -> DataFrame:
        return self.table("lowest")

    def of_buckets(self, name: str, schema: str, buckets: list[int]) -> DataFrame:
        """Postings or frequencies of some buckets; other folders are not read."""
        found = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        whole = len(buckets) >= self.parts
        return found.filter(F.col("bucket") != GROUPS if whole else F.col("bucket").isin(buckets))

    def postings(self, kind: str, buckets: list[int]) -> DataFrame:
        """``bucket, group, term, n, chunks, places`` of the terms or of the lexemes."""
        found = self.of_buckets("postings", POSTINGS_SCHEMA, buckets)
        term = F.col("word") if kind == served.LEXEMES else F.coalesce("term", "word")
        return found.select("bucket", "group", term.alias("term"), "n", "chunks", "places")

    def groups(self) -> DataFrame:
        """The chunks each group of postings is about."""
        found = self.spark.read.schema(POSTINGS_SCHEMA).parquet(f"{self.path}/postings")
        return found.filter(F.col("bucket") == GROUPS).select("group", "chunks")

    def frequencies(self, kind: str, buckets: list[int]) -> DataFrame:
        return self.of_buckets("frequencies", FREQUENCIES_SCHEMA, buckets).filter(F.col("kind") == kind)

    def chunks_of(self, references: DataFrame) -> DataFrame:
        """Chunk records named by ``chunk_id`` of few references; parts without one are not read."""
        named = references.select("chunk_id").distinct()
        part = bucket_of(F.col("chunk_id"), self.parts)
        parts = sorted(r[0] for r in named.select(part).distinct().collect())
        stored = self.table("chunks").filter(F.col("part").isin(parts))
        return stored.drop("part").join(F.broadcast(named), "chunk_id", "left_semi")


class SnapshotStore:
    """``attempts`` and their commits below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _folder(self, attempt: str) -> str:
        return f"{self.path}/attempts/{attempt}"

    def snapshots(self) -> DataFrame:
        return self.log.rows(SNAPSHOT_SCHEMA)

    def active_snapshot(self) -> DataFrame:
        return snapshots.active_snapshot(self.snapshots())

    def open(self, snapshot_id: str | None = None) -> StoredSnapshot:
        """A committed snapshot, by default the active one."""
        if snapshot_id is None:
            row = self.active_snapshot().first()
        else:
            row = self.snapshots().filter((F.col("id") == snapshot_id) & (F.col("status") == "active")).first()
        if row is None:
            raise ValueError("no such snapshot" if snapshot_id else "no active snapshot")
        return StoredSnapshot(
            self.spark, self._folder(row["attempt"]), row["id"], row["snapshot_hash"],
            row["chunk_count"], row["dimension"], row["parts"],
        )

    def chunks(self, snapshot_id: str) -> DataFrame:
        """Chunks of one snapshot; no file of another one is read."""
        return self.open(snapshot_id).chunks()

    def stored_hashes(self) -> DataFrame:
        """Last ingested content hash per path; only snapshots that were committed count."""
        active = self.snapshots().filter("status = 'active'").select("attempt", "sequence").collect()
        held = None
        for row in active:
            part = self.spark.read.parquet(f"{self._folder(row['attempt'])}/documents")
            held = part if held is None else held.unionByName(part)
        if held is None:
            return self.spark.createDataFrame([], "source_path string, content_sha256 string")
        return held.groupBy("source_path").agg(F.max_by("content_sha256", "sequence").alias("content_sha256"))

    def ingest(
        self,
        revisions: DataFrame,
        dry_run: bool = False,
        fail_after_extract: bool = False,
        window: int = chunking.DEFAULT_WINDOW,
        overlap: int = chunking.DEFAULT_OVERLAP,
        dimension: int = DEFAULT_DIMENSION,
        cells: int | None = None,
        parts: int | None = None,
        ledger: LedgerStore | None = None,
        ledger_id: str = "main",
        timestamp_ms: int = 0,
    ) -> IngestResult:
        """Report, skip, fail or publish a snapshot, depending on what changed.

        ``ledger`` receives the event of an activated snapshot; an ingest that died between commit
        and event is made up for by the next one.
        """
        if dry_run:
            summary = snapshots.ingest_summary(
                revisions, self.stored_hashes(), True, fail_after_extract, window, overlap
            ).first()
            return IngestResult(**summary.asDict(), snapshot_id=None)
        attempt = new_attempt()
        with settings(self.spark, {TIDY_SETTING: "true"}):
            done = self._ingest_from(
                revisions, f"{self._folder(attempt)}/revisions", fail_after_extract, window, overlap,
                dimension, cells, parts, ledger, ledger_id, timestamp_ms,
            )
        remove_attempt(self.log, self._folder(attempt))
        return done

    def _ingest_from(
        self, revisions: DataFrame, source: str, fail_after_extract: bool, window: int, overlap: int,
        dimension: int, cells: int | None, parts: int | None, ledger: LedgerStore | None, ledger_id: str,
        timestamp_ms: int,
    ) -> IngestResult:
        # Counted while the text is read anyway; no later step cuts it only to count.
        counted_once = revisions.withColumn(snapshots.TOKENS, snapshots.counted_tokens(F.col("text")))
        counted_once.write.option("compression", COMPRESSION).parquet(source)
        staged = self.spark.read.parquet(source)
        while True:
            summary = snapshots.ingest_summary(
                staged, self.stored_hashes(), False, fail_after_extract, window, overlap
            ).first()
            if summary["no_op"]:
                active = self.active_snapshot().first()
                self._record(active, ledger, ledger_id, timestamp_ms)
                return IngestResult(**summary.asDict(), snapshot_id=active["id"] if active else None)
            sequence = snapshots.next_sequence(self.snapshots()).first()["next_sequence"]
            status = "failed" if fail_after_extract else "active"
            counted = summary["document_count"], summary["chunk_count"]
            row = snapshots.snapshot_row(staged, sequence, status, window, overlap, counted=counted).first().asDict()
            row |= {"attempt": new_attempt(), "dimension": dimension, "parts": parts or default_parts(row["chunk_count"])}
            if status == "active":
                self._stage(staged, row, window, overlap, cells)
            if self.log.publish(f"{sequence:010d}", row):
                break
        if status == "active":
            self._record(self.active_snapshot().first(), ledger, ledger_id, timestamp_ms)
        return IngestResult(**summary.asDict(), snapshot_id=row["id"])

    def _record(self, head, ledger: LedgerStore | None, ledger_id: str, timestamp_ms: int) -> None:
        """Write the event of an activated snapshot unless the ledger holds it."""
        if ledger is None or head is None:
            return
        if ledger.log.names():
            told = (F.col("entry_type") == snapshots.INGEST_EVENT) & (F.col("corpus_snapshot_id") == head["id"])
            if not ledger.entries().filter(told).isEmpty():
                return
        row = self.spark.createDataFrame([head.asDict()], SNAPSHOT_SCHEMA)
        ledger.append(
            snapshots.ingest_events(row, F.lit(ledger_id), F.lit(timestamp_ms)), ["append_order"]
        )

    def remove_abandoned(self, older_than_ms: int) -> list[str]:
        """Delete attempts that were never committed."""
        named = {r["attempt"] for r in self.snapshots().select("attempt").collect()}
        return remove_abandoned(self.log, f"{self.path}/attempts", named, older_than_ms)

    # ---- staging --------------------------------------------------------------------------------

    def _stage(self, staged: DataFrame, row: dict, window: int, overlap: int, cells: int | None) -> None:
        folder, parts = self._folder(row["attempt"]), row["parts"]
        salts = max(1, row["chunk_count"] // CHUNKS_PER_SALT)
        documents = staged.select("source_path", "source_type", "content_sha256")
        documents.withColumn("sequence", F.lit(row["sequence"])).write.parquet(f"{folder}/documents")
        records = chunking.chunk_records(
            chunking.token_windows_with_offsets(self._spread(staged.drop(snapshots.TOKENS)), window, overlap),
            F.lit(row["id"]),
            F.lit(row["snapshot_hash"]),
        ).withColumn("part", bucket_of(F.col("chunk_id"), parts))
        records.repartition("part").sortWithinPartitions("part", "chunk_id").write.option(
            "compression", COMPRESSION
        ).partitionBy("part").parquet(f"{folder}/chunks")
        chunks = self.spark.read.parquet(f"{folder}/chunks")
        self._stage_vectors(chunks, folder, row, cells, salts)
        self._stage_postings(chunks, folder, parts, salts)
        lowest = chunks.select("chunk_id", "source_path").orderBy("chunk_id").limit(LOWEST_IDS)
        lowest.coalesce(1).write.parquet(f"{folder}/lowest")

    def _spread(self, staged: DataFrame) -> DataFrame:
        """Few small files are dealt over the cores before their text is cut."""
        cores = self.spark.sparkContext.defaultParallelism
        small = sum(path_bytes(self.spark, f) for f in staged.inputFiles()[:cores]) < SPREAD_BYTES_PER_CORE * cores
        return staged.repartition(cores) if small and len(staged.inputFiles()) < cores else staged

    def _stage_vectors(self, chunks: DataFrame, folder: str, row: dict, cells: int | None, salts: int) -> None:
        wanted = cells or vector_index.default_cells(row["chunk_count"])
        sample = vector_index.sampled(
            chunks.select("chunk_id", "chunk_text"), "chunk_id", row["chunk_count"],
            vector_index.sample_rows(wanted, row["dimension"]),
        )
        vector = hash_embedding(F.col("chunk_text"), row["dimension"]).alias("vector")
        fitted = vector_index.fit_cells(sample.select(F.col("chunk_id").alias("id"), vector), wanted)
        fitted.coalesce(1).write.parquet(f"{folder}/cells")
        found = self.spark.read.parquet(f"{folder}/cells")
        vectors = vector_index.with_cells(chunks.select(key_of(F.col("chunk_id")).alias("key"), vector), found)
        salt = F.pmod(F.xxhash64("key", F.lit(31)), F.lit(salts))
        vectors.repartition("cell", salt).write.partitionBy("cell").parquet(f"{folder}/vectors")

    def _stage_postings(self, chunks: DataFrame, folder: str, parts: int, salts: int) -> None:
        salt = F.pmod(F.xxhash64("chunks", F.lit(37)), F.lit(max(1, salts // POSTING_ROUNDS)))
        term = F.coalesce("term", "word")
        bucket = F.when(F.col("word").isNull(), F.lit(GROUPS)).otherwise(bucket_of(term, parts))
        for number in range(POSTING_ROUNDS):
            some = chunks.filter(F.col("part") % POSTING_ROUNDS == number)
            postings = served.group_postings(some, key_of(F.col("chunk_id")), number)
            dealt = postings.withColumn("bucket", bucket).repartition("bucket", salt)
            dealt.sortWithinPartitions("bucket", "word").write.mode("append").option(
                "compression", COMPRESSION
            ).partitionBy("bucket").parquet(f"{folder}/postings")
        kinds = F.array(
            F.struct(F.lit(served.TERMS).alias("kind"), term.alias("term"), F.col("n_term").alias("n")),
            F.struct(F.lit(served.LEXEMES).alias("kind"), F.col("word").alias("term"), "n"),
        )
        stored = self.spark.read.schema(POSTINGS_SCHEMA).parquet(f"{folder}/postings")
        counted = stored.select("bucket", F.inline(kinds)).filter("n > 0").groupBy("kind", "bucket", "term").agg(
            F.sum("n").alias("df")
        )
        counted.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "term").write.partitionBy(
            "kind", "bucket"
        ).parquet(f"{folder}/frequencies")
