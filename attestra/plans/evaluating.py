"""Golden runs: cases answered over a corpus, scored, and recorded with what they ran on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.domain import DEFAULT_EMBEDDING_MODEL, DEFAULT_PROMPT, EXTRACTIVE_PROFILE
from attestra.functions import canonical_json as J
from attestra.operators import evaluation, generation, snapshots
from attestra.operators.chunking import CHUNKER_VERSION
from attestra.operators.topk import fits_broadcast
from attestra.plans.retrieval import REFERENCE_BROADCAST_ROWS, retrieve
from attestra.session import cut_lineage
from attestra.sources.fixtures import load_fixture_corpus
from attestra.sources.json_lines import read_golden


def outcomes_over_chunks(chunks: DataFrame, queries: DataFrame, snapshot_id: str, snapshot_hash: str) -> DataFrame:
    """Outcomes of questions over given chunks (``chunk_id, source_path, chunk_text``)."""
    found = retrieve(chunks, queries, materialize=True)
    cited = cut_lineage(found.evidence.select("query_id", "rank", "chunk_id", "source_path", "score"))
    small = fits_broadcast(cited, REFERENCE_BROADCAST_ROWS)
    evidence = chunks.select("chunk_id", "chunk_text").join(
        F.broadcast(cited) if small else cited, "chunk_id"
    ).withColumn("corpus_snapshot_id", F.lit(snapshot_id))
    return generation.answer_outcomes(
        queries, found.refused, cut_lineage(evidence), F.lit(snapshot_id), F.lit(snapshot_hash),
        generation.extractive_provider, EXTRACTIVE_PROFILE, DEFAULT_PROMPT, True,
    )


def golden_verdicts(cases: DataFrame, chunks: DataFrame, snapshot_id: str, snapshot_hash: str) -> DataFrame:
    """The three verdicts of every golden case (``read_golden``) over a chunked corpus."""
    queries = cases.select(F.col("id").alias("query_id"), F.col("question").alias("query_text"))
    outcomes = outcomes_over_chunks(chunks, queries, snapshot_id, snapshot_hash)
    return evaluation.score_cases(cases, outcomes.withColumnRenamed("query_id", "id"))


def pinned_tuple(corpus_hash: str) -> dict[str, str]:
    """What a run's figures depend on."""
    return {
        "chunkerVersion": CHUNKER_VERSION,
        "corpusHash": corpus_hash,
        "embeddingModelVersion": DEFAULT_EMBEDDING_MODEL,
        "modelVersion": EXTRACTIVE_PROFILE.model_version,
        "promptVersion": DEFAULT_PROMPT.version,
    }


def run_record(verdicts: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """One row: status, case_count, the metrics, and as canonical JSON the pinned tuple, the
    thresholds, the metrics by tag and all of it (``output_json``)."""
    verdicts = cut_lineage(verdicts)

    def metrics() -> dict:
        return {name: J.json_fixed6(F.round(name, 6)) for name in evaluation.THRESHOLDS}

    run = evaluation.evaluation_run(verdicts)
    tags = evaluation.tag_breakdown(verdicts).select(
        F.struct(
            "tag",
            J.json_object({"caseCount": J.json_integer(F.col("case_count"))} | metrics()).alias("body"),
        ).alias("t")
    )
    listed = F.transform(
        F.array_sort(F.collect_list("t")),
        lambda t: F.concat(J.json_string(t["tag"]), F.lit(":"), t["body"]),
    )
    by_tag = tags.agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("j")).scalar()
    thresholds = J.canonical_text(evaluation.THRESHOLDS)
    parts = run.withColumn("per_tag_breakdown", by_tag).withColumns(
        {"pinned_tuple": F.lit(J.canonical_text(pinned)), "thresholds": F.lit(thresholds)}
    )
    output = J.json_object(
        {
            "caseCount": J.json_integer(F.col("case_count")),
            "perTagBreakdown": F.col("per_tag_breakdown"),
            "pinnedTuple": F.col("pinned_tuple"),
            "status": J.json_string(F.col("status")),
            "thresholds": F.col("thresholds"),
        }
        | metrics()
    )
    return parts.withColumn("output_json", output)


def run_golden(spark: SparkSession, golden_path: str, corpus_dir: str) -> DataFrame:
    """The run record of a golden file over a folder of hand-chunked files."""
    chunks = cut_lineage(load_fixture_corpus(spark, corpus_dir))
    corpus_hash = snapshots.fixture_corpus_hash(chunks).first()["corpus_hash"]
    verdicts = golden_verdicts(read_golden(spark, golden_path), chunks, corpus_hash, corpus_hash)
    return run_record(verdicts, pinned_tuple(corpus_hash))
