"""Replay of ledgered answers: name what drifted, regenerate, compare bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.domain import DEFAULT_PROMPT, EXTRACTIVE_PROFILE, PromptTemplate, ProviderProfile
from attestra.functions import canonical_json as J
from attestra.functions import hashing
from attestra.operators.generation import (
    Provider,
    attempts,
    extractive_provider,
    prompts,
)

# Operator messages.
MESSAGE_PASSED = "Replay erfolgreich: Die Antwort ist bytegleich."
MESSAGE_UNSUPPORTED = "Replay wird vom Providerprofil nicht unterstuetzt."
MESSAGE_DRIFT = "Replay-Abweichung erkannt: "

REPLAY_OUTCOMES = {
    "passed": "replay-success",
    "drift": "replay-drift",
    "unsupported": "replay-unsupported",
}


@dataclass(frozen=True)
class ReplayArtifacts:
    """Artifacts in force at replay time; a column left out is taken from the entry itself."""

    corpus_snapshot_hash: Column | None = None
    prompt_hash: Column | None = None
    embedding_model_version: Column | None = None
    model_version: Column | None = None


def artifact_drift(artifacts: ReplayArtifacts) -> Column:
    """First artifact that differs from the entry, in fixed order; null without drift."""

    def moved(name: str) -> Column:
        current = getattr(artifacts, name)
        return F.lit(False) if current is None else ~F.col(name).eqNullSafe(current)

    return (
        F.when(moved("corpus_snapshot_hash"), F.lit("corpus_snapshot"))
        .when(moved("prompt_hash"), F.lit("prompt"))
        .when(moved("embedding_model_version"), F.lit("embedding_model"))
        .when(moved("model_version"), F.lit("model"))
    )


STORED_CHUNKS = "array<struct<chunkId:string,chunkText:string,corpusSnapshotId:string>>"


def stored_evidence(entries: DataFrame) -> DataFrame:
    """``query_id, rank, chunk_id, chunk_text, corpus_snapshot_id`` of the chunks a ledger row holds."""
    chunks = F.posexplode(F.from_json("retrieved_chunks", STORED_CHUNKS)).alias("place", "c")
    return entries.select(F.col("id").alias("query_id"), chunks).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("c.chunkId").alias("chunk_id"),
        F.col("c.chunkText").alias("chunk_text"),
        F.col("c.corpusSnapshotId").alias("corpus_snapshot_id"),
    )


def regenerate(
    entries: DataFrame,
    provider: Provider = extractive_provider,
    template: PromptTemplate = DEFAULT_PROMPT,
    deterministic: bool = True,
) -> DataFrame:
    """``id, regenerated``: the answer the provider gives to the prompt of each ledger row.

    The prompt is rebuilt from the stored question and chunks. Rows without a question or an answer
    are left out. An answer that fails validation regenerates as empty.
    """
    asked = entries.filter(F.col("query_text").isNotNull() & F.col("generated_answer").isNotNull())
    evidence = stored_evidence(asked)
    prompt_rows = prompts(asked.select(F.col("id").alias("query_id"), "query_text"), evidence, template)
    snapshot = asked.select(
        F.col("id").alias("query_id"), F.col("corpus_snapshot_id").alias("_entry_snapshot")
    )
    own = F.col("corpus_snapshot_id").eqNullSafe(F.col("_entry_snapshot"))
    known = evidence.join(snapshot, "query_id").withColumn(
        "corpus_snapshot_id", F.when(own, F.lit("same")).otherwise(F.lit("other"))
    )
    answers = attempts(prompt_rows, provider, known, F.lit("same"), deterministic)
    return answers.select(
        F.col("query_id").alias("id"),
        F.when(F.size("errors") > 0, F.lit("")).otherwise(F.col("answer")).alias("regenerated"),
    )


def replay_entries(
    entries: DataFrame,
    artifacts: ReplayArtifacts | None = None,
    provider: Provider = extractive_provider,
    profile: ProviderProfile = EXTRACTIVE_PROFILE,
    template: PromptTemplate = DEFAULT_PROMPT,
    deterministic: bool = True,
) -> DataFrame:
    """One result per ledger row, from nothing but the row.

    The capability is tested before anything else, then artifacts, then bytes. Entries without a
    question or an answer cannot be replayed; they report status ``error`` with drift ``unknown``
    and produce no ledger row.
    """
    used = artifacts or ReplayArtifacts()
    unsupported = F.lit(profile.replay_capability == "unsupported")
    compared = (
        entries.withColumn("_drift", artifact_drift(used))
        .join(regenerate(entries, provider, template, deterministic), "id", "left")
        .withColumn(
            "_unknown", F.col("query_text").isNull() | F.col("generated_answer").isNull()
        )
        .withColumn("_equal", F.col("regenerated").eqNullSafe(F.col("generated_answer")))
    )
    status = (
        F.when(unsupported, F.lit("unsupported"))
        .when(F.col("_drift").isNotNull(), F.lit("drift"))
        .when(F.col("_unknown"), F.lit("error"))
        .when(~F.col("_equal"), F.lit("drift"))
        .otherwise(F.lit("passed"))
    )
    ran = ~unsupported & F.col("_drift").isNull() & ~F.col("_unknown")
    drift = (
        F.when(F.col("_drift").isNotNull(), F.col("_drift"))
        .when(unsupported, F.lit(None))
        .when(F.col("_unknown"), F.lit("unknown"))
        .when(~F.col("_equal"), F.lit("provider_infrastructure"))
    )
    result = compared.withColumns(
        {
            "status": status,
            "byte_equal": F.when(unsupported, F.lit(None).cast("boolean"))
            .when(F.col("_drift").isNotNull(), F.lit(False))
            .when(F.col("_unknown"), F.lit(None).cast("boolean"))
            .otherwise(F.col("_equal")),
            "drift_artifact": drift,
            "regenerated_answer_sha256": F.when(ran, hashing.sha256_hex(F.col("regenerated"))),
        }
    )
    message = (
        F.when(F.col("status") == "passed", F.lit(MESSAGE_PASSED))
        .when(F.col("status") == "unsupported", F.lit(MESSAGE_UNSUPPORTED))
        .otherwise(F.concat(F.lit(MESSAGE_DRIFT), F.coalesce("drift_artifact", F.lit("unbekannt")),
                            F.lit(".")))
    )
    return result.withColumn("operator_message", message).drop(
        "_drift", "_unknown", "_equal", "regenerated"
    )


def replay_inputs(
    results: DataFrame, profile: ProviderProfile = EXTRACTIVE_PROFILE
) -> DataFrame:
    """Ledger inputs recording each replay next to the entry it repeats."""
    outcome = F.create_map(*[F.lit(x) for kv in REPLAY_OUTCOMES.items() for x in kv])
    metadata = J.json_object(
        {
            "originalLedgerEntryId": J.json_string(F.col("id")),
            "byteEqual": J.json_boolean(F.col("byte_equal")),
            "driftArtifact": J.json_string(F.col("drift_artifact")),
            "originalGeneratedAnswerSha256": J.json_string(F.col("generated_answer_sha256")),
            "regeneratedAnswerSha256": J.json_string(F.col("regenerated_answer_sha256")),
        }
    )
    return results.filter(F.col("status") != "error").select(
        "ledger_id",
        F.concat(F.lit("replay."), "status").alias("entry_type"),
        outcome[F.col("status")].alias("outcome"),
        F.col("status").alias("generated_answer"),
        F.lit(profile.model_version).alias("model_version"),
        "prompt_version",
        "embedding_model_version",
        F.lit(profile.id).alias("provider_profile_id"),
        F.lit(profile.replay_capability).alias("provider_replay_capability"),
        "seed",
        "corpus_snapshot_id",
        "corpus_snapshot_hash",
        "prompt_hash",
        "user_id_hash",
        "timestamp_ms",
        metadata.alias("metadata"),
    )


def replays_with_originals(entries: DataFrame) -> DataFrame:
    """Replay rows next to the entry they repeat, by the id kept in their metadata."""
    replays = entries.filter(F.col("entry_type").startswith("replay.")).select(
        F.get_json_object("metadata", "$.originalLedgerEntryId").alias("original_id"),
        F.col("id").alias("replay_id"),
        F.col("outcome").alias("replay_outcome"),
    )
    originals = entries.select(
        F.col("id").alias("original_id"), F.col("outcome").alias("original_outcome")
    )
    return replays.join(originals, "original_id", "left")
