"""Hooks for remote embedding and answer services.

A service is a plain callable on a list of texts. Spark partitions the texts; each task calls the
service per Arrow batch, retries transient failures with full jitter and validates what comes back.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from attestra.operators.generation import Provider

# Retry policy and transient HTTP statuses.
RETRIES = 3
BASE_DELAY_MS = 250
MAX_DELAY_MS = 4_000
TIMEOUT_STATUS, TOO_MANY_STATUS, SERVER_ERROR_STATUS = 408, 429, 500


class TransientServiceError(Exception):
    """A failure worth repeating."""


def is_transient_status(status: int) -> bool:
    return status in (TIMEOUT_STATUS, TOO_MANY_STATUS) or status >= SERVER_ERROR_STATUS


def backoff_delay_ms(
    attempt: int,
    base_ms: int = BASE_DELAY_MS,
    max_ms: int = MAX_DELAY_MS,
    draw: Callable[[], float] = random.random,
) -> float:
    """Uniform between zero and the capped exponential step."""
    return draw() * min(base_ms * 2**attempt, max_ms)


def with_retries(
    call: Callable[[], object],
    retries: int = RETRIES,
    sleep: Callable[[float], None] = time.sleep,
) -> object:
    for attempt in range(retries):
        try:
            return call()
        except (TransientServiceError, TimeoutError, ConnectionError):
            sleep(backoff_delay_ms(attempt) / 1000)
    return call()


def checked_vector(vector: list, dimension: int) -> list[float]:
    if len(vector) != dimension:
        raise ValueError(f"embedding has {len(vector)} values, expected {dimension}")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector):
        raise ValueError("embedding contains non-numeric values")
    if not all(math.isfinite(x) for x in vector):
        raise ValueError("embedding contains non-finite values")
    if all(x == 0 for x in vector):
        raise ValueError("embedding is all zeros, which has no cosine direction")
    return [float(x) for x in vector]


def embed_with_service(
    texts: DataFrame, service: Callable[[list[str]], list[list[float]]], dimension: int
) -> DataFrame:
    """Add ``vector`` to every row of ``text``; vectors stay in the row they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch["text"].tolist()
            got = with_retries(lambda asked=asked: service(asked))
            if len(got) != len(asked):
                raise ValueError(f"service returned {len(got)} vectors for {len(asked)} texts")
            yield batch.assign(vector=[checked_vector(v, dimension) for v in got])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(run, f"{kept}, vector array<double>")


def service_provider(service: Callable[[list[str]], list[str]]) -> Provider:
    """An answer provider backed by a service on prompts."""

    def provide(prompts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                asked = batch["prompt"].tolist()
                answers = with_retries(lambda asked=asked: service(asked))
                yield pd.DataFrame({"query_id": batch["query_id"], "answer": answers})

        key = prompts.schema["query_id"].dataType.simpleString()
        return prompts.select("query_id", "prompt").mapInPandas(
            run, f"query_id {key}, answer string"
        )

    return provide
