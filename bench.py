"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from attestra.plans.retrieval import retrieve
from attestra.plans.stored import retrieve_stored
from attestra.session import checkpoint_directory
from attestra.sources.snapshot_store import SnapshotStore
from checks.compare import local_session
from checks.registry import QUERIES, corpus, questions, revisions

HEADLINE = (
    "text_terms",
    "chunk_records",
    "corpus_snapshot",
    "ingest_summary",
    "term_weights",
    "lexical_candidates",
    "cited_evidence",
    "semantic_retrieval",
    "served_retrieval",
    "dense_top_k",
    "hash_embedding_cells",
    "cited_answers",
    "replay_status",
    "evaluation_run",
    "ledger_append",
    "ledger_verify_tampered",
    "report_facts",
    "attempt_limits_per_user",
    "session_validity",
    "html_article",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores)
    # One throw-away run starts the JVM's compilers and the Python workers.
    for name in ("cited_evidence", "hash_embedding_cells"):
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    # One question pays the corpus pass alone; the batch shares it.
    start = time.perf_counter()
    asked = questions(spark, directory).orderBy("query_id").limit(1)
    retrieve(corpus(spark, directory), asked).evidence.write.format("noop").mode("overwrite").save()
    single = round(time.perf_counter() - start, 3)
    # The same question over a stored snapshot, which is built once.
    store = SnapshotStore(spark, f"{checkpoint_directory(spark)}/bench-{uuid.uuid4().hex}")
    store.ingest(revisions(spark, directory))
    corpus_store = store.open()
    start = time.perf_counter()
    retrieve_stored(corpus_store, asked).evidence.write.format("noop").mode("overwrite").save()
    single_stored = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", directory)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "single_question_seconds": single,
                "single_stored_question_seconds": single_stored,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
