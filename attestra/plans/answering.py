"""Question answering over a corpus: retrieve, cite, validate, record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.domain import EXTRACTIVE_PROFILE, PromptTemplate, DEFAULT_PROMPT, ProviderProfile
from attestra.functions import hashing
from attestra.functions import canonical_json as J
from attestra.operators import generation
from attestra.operators.chunking import chunk_keys, token_windows
from attestra.operators.ledger import citations_json, retrieved_chunks_json
from attestra.plans.retrieval import Retrieval, fetch_chunk_text, retrieve
from attestra.session import cut_lineage


def corpus(revisions: DataFrame, snapshot_id: str) -> DataFrame:
    """Chunks of a corpus with only the columns ranking reads."""
    return chunk_keys(token_windows(revisions.select("source_path", "text")), F.lit(snapshot_id))


def answer_queries(
    revisions: DataFrame,
    queries: DataFrame,
    snapshot_id: str,
    snapshot_hash: str,
    top_k: int | None = None,
    provider: generation.Provider = generation.extractive_provider,
    profile: ProviderProfile = EXTRACTIVE_PROFILE,
    template: PromptTemplate = DEFAULT_PROMPT,
    deterministic: bool = True,
) -> tuple[DataFrame, DataFrame, Retrieval]:
    """Outcomes, cited evidence with text, and the retrieval they rest on."""
    found = retrieve(corpus(revisions, snapshot_id), queries, top_k, materialize=True)
    evidence = cut_lineage(
        fetch_chunk_text(
            revisions,
            found.evidence.select("query_id", "rank", "chunk_id", "source_path", "score"),
            snapshot_id,
        )
    )
    outcomes = generation.answer_outcomes(
        queries,
        found.refused,
        evidence,
        F.lit(snapshot_id),
        F.lit(snapshot_hash),
        provider,
        profile,
        template,
        deterministic,
    )
    return outcomes, evidence, found


def query_ledger_inputs(
    outcomes: DataFrame,
    evidence_records: DataFrame,
    ledger_id: str,
    user_id_hash: str,
    session_id: str,
    timestamp_ms: int,
) -> DataFrame:
    """Ledger inputs of answered queries.

    ``evidence_records`` carries full chunk records with ``query_id, rank, score``.
    """
    chunk = F.struct(
        "rank",
        *[c for c in evidence_records.columns if c not in ("query_id", "rank", "score", "method",
                                                           "evidence", "fused_rank")],
        F.col("score").alias("retrieval_score"),
        F.lit("rrf").alias("retrieval_method"),
    )
    lists = evidence_records.groupBy("query_id").agg(
        F.array_sort(F.collect_list(chunk)).alias("_chunks")
    )
    cited = F.flatten(
        F.transform(
            "claims",
            lambda c: F.transform(
                c["cited"],
                lambda i: F.struct(c["claim_index"].alias("claim_index"), i.alias("chunk_id")),
            ),
        )
    )
    query_id = hashing.stable_id(
        "query", hashing.sha256_hex(F.col("query_text")), F.lit(session_id)
    )
    return outcomes.join(lists, "query_id", "left").select(
        F.lit(ledger_id).alias("ledger_id"),
        F.col("query_id").alias("append_order"),
        F.concat(F.lit("query."), F.replace("outcome", F.lit("-"), F.lit("_"))).alias("entry_type"),
        "outcome",
        "query_text",
        F.coalesce(retrieved_chunks_json(F.col("_chunks")), F.lit("[]")).alias("retrieved_chunks"),
        citations_json(cited).alias("claim_citations"),
        F.col("answer").alias("generated_answer"),
        "model_version",
        "prompt_version",
        "embedding_model_version",
        "provider_profile_id",
        "provider_replay_capability",
        "seed",
        "corpus_snapshot_id",
        "corpus_snapshot_hash",
        "prompt_hash",
        F.lit(user_id_hash).alias("user_id_hash"),
        F.lit(timestamp_ms).cast("bigint").alias("timestamp_ms"),
        J.json_object({"queryId": J.json_string(query_id)}).alias("metadata"),
    )


def result_summary(outcomes: DataFrame, entries: DataFrame, session_id: str) -> DataFrame:
    """What a client sees of each query."""
    keyed = entries.select(
        F.col("append_order").alias("query_id"), F.col("id").alias("ledger_entry_id")
    )
    return outcomes.join(keyed, "query_id", "left").select(
        "outcome",
        "answer",
        hashing.stable_id(
            "query", hashing.sha256_hex(F.col("query_text")), F.lit(session_id)
        ).alias("query_id"),
        "corpus_snapshot_id",
        "corpus_snapshot_hash",
        "answer_hash",
        "claims",
        "ledger_entry_id",
    )
