"""Rank fusion, the evidence filter and the refusal gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.lexical import (
    BM25,
    EVIDENCE_THRESHOLD,
    SCORE_DECIMALS,
    candidate_order,
)
from attestra.operators.topk import rank_within

# Fixed values of the fusion.
RRF_K = 60
DEFAULT_TOP_K = 8
MAX_TOP_K = 20
RRF = "rrf"


def parse_top_k(top_k: int | None) -> int:
    if top_k is None:
        return DEFAULT_TOP_K
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be an integer from 1 through {MAX_TOP_K}")
    return top_k


def is_finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))


def reciprocal_rank_fusion(candidates: DataFrame) -> DataFrame:
    """Sum of 1/(60+rank) over all rankings a chunk appears in.

    One aggregation replaces the outer join of the two lists and, at the same time, looks up the
    score the evidence bar reads. Input: ``query_id, method, rank, chunk_id, source_path, score``.
    """
    share = F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))
    fused = candidates.groupBy("query_id", "chunk_id", "source_path").agg(
        F.round(F.sum(share), SCORE_DECIMALS).alias("score"),
        F.coalesce(F.max(F.when(F.col("method") == BM25, F.col("score"))), F.lit(0.0)).alias(
            "evidence"
        ),
    )
    return rank_within(fused, ["query_id"], candidate_order(), "rank").withColumn(
        "method", F.lit(RRF)
    )


def cited_evidence(fused: DataFrame, top_k: int | None = None) -> DataFrame:
    """Fused chunks that clear the evidence bar on their pre-fusion score, best ``top_k`` first."""
    k = parse_top_k(top_k)
    kept = fused.filter(F.col("evidence") >= EVIDENCE_THRESHOLD).withColumnRenamed(
        "rank", "fused_rank"
    )
    return rank_within(kept, ["query_id"], [F.col("fused_rank").asc()], "rank").filter(
        F.col("rank") <= k
    )


def best_candidate(candidates: DataFrame) -> DataFrame:
    """``query_id, best`` evidence score of ranked candidates."""
    return (
        candidates.filter(F.col("method") == BM25)
        .groupBy("query_id")
        .agg(F.max("score").alias("best"))
    )


def refusal_gate(queries: DataFrame, best: DataFrame) -> DataFrame:
    """One row per query: best evidence score and whether the query is out of corpus.

    ``best``: ``query_id, best`` over all chunks of the corpus.
    """
    score = F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.lit(0.0))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        score.alias("best_evidence"),
        (score < EVIDENCE_THRESHOLD).alias("out_of_corpus"),
    )


def finite_candidates(candidates: DataFrame) -> DataFrame:
    """Drop scores that are no scores before anything is ranked or compared."""
    return candidates.filter(is_finite(F.col("score")))


def served_gate(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gate of the stored-vector path: the best finite score of either ranker decides."""
    best = finite_candidates(candidates).groupBy("query_id").agg(F.max("score").alias("best"))
    score = F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.lit(0.0))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        score.alias("best_evidence"),
        (score < EVIDENCE_THRESHOLD).alias("out_of_corpus"),
    )
