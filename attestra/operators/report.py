"""Compliance report over a ledger window."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import hashing
from attestra.functions.hashing import NOT_APPLICABLE
from attestra.operators.ledger import window_entries

REPORT_ENTRY = "report.generated"
VERSION_COLUMNS = {
    "model_versions": "model_version",
    "prompt_versions": "prompt_version",
    "embedding_versions": "embedding_model_version",
    "corpus_snapshots": "corpus_snapshot_id",
    "corpus_snapshot_hashes": "corpus_snapshot_hash",
}


def parse_iso_ms(value: str, field: str) -> int:
    try:
        moment = datetime.fromisoformat(value)
    except ValueError as error:
        raise ValueError(f"{field} must be an ISO timestamp") from error
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return round(moment.timestamp() * 1000)


def iso_from_ms(timestamp_ms: int) -> str:
    moment = datetime.fromtimestamp(timestamp_ms / 1000, tz=timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{timestamp_ms % 1000:03d}Z"


def iso_from_ms_column(timestamp_ms: Column) -> Column:
    moment = F.timestamp_millis(timestamp_ms)
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def window_label(since: str, until: str) -> str:
    return f"{iso_from_ms(parse_iso_ms(since, 'since'))}..{iso_from_ms(parse_iso_ms(until, 'until'))}"


def parse_window(since: str, until: str) -> tuple[int, int]:
    start, end = parse_iso_ms(since, "since"), parse_iso_ms(until, "until")
    if start >= end:
        raise ValueError("since must be earlier than until")
    return start, end


def outcome_breakdown(entries: DataFrame) -> DataFrame:
    return entries.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def report_facts(entries: DataFrame, since: str, until: str) -> DataFrame:
    """One row: distinct versions, query volume and refusal rate inside the window.

    Version sets hold one value per artifact version, not per row, and are combined map side.
    """
    start, end = parse_window(since, until)
    rows = window_entries(entries, start, end, (REPORT_ENTRY,))
    query = F.col("entry_type").startswith("query.")
    refused = query & (F.col("outcome") == "refused-out-of-corpus")
    versions = [
        F.array_sort(
            F.collect_set(F.when(F.col(source) != NOT_APPLICABLE, F.col(source)))
        ).alias(name)
        for name, source in VERSION_COLUMNS.items()
    ]
    return rows.agg(
        *versions,
        F.count(F.when(query, 1)).alias("query_volume"),
        F.count(F.when(refused, 1)).alias("_refused"),
    ).select(
        F.lit(since).alias("since"),
        F.lit(until).alias("until"),
        *VERSION_COLUMNS,
        "query_volume",
        F.when(F.col("query_volume") == 0, F.lit(0.0))
        .otherwise(F.col("_refused") / F.col("query_volume"))
        .alias("refusal_rate"),
    )


def bundle_hash(json_sha: Column, pdf_sha: Column, zip_sha: Column) -> Column:
    return hashing.sha256_hex(F.concat_ws("|", json_sha, pdf_sha, zip_sha))


def health(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Row counts of ledger and corpus in one row."""
    return entries.agg(F.count(F.lit(1)).alias("ledger_rows")).select(
        "ledger_rows", chunks.select(F.count(F.lit(1)).alias("n")).scalar().alias("chunk_rows")
    )
