"""Golden-set evaluation and gate separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.topk import default_fanout, top_k

# Pass thresholds.
THRESHOLDS = {
    "groundedness": 0.95,
    "citation_accuracy": 0.95,
    "refusal_correctness": 0.90,
}


def score_cases(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Three verdicts per case; a case without an outcome fails all of them.

    ``cases``: ``id, expected_outcome, expected_chunks, tags``.
    ``outcomes``: ``id, outcome, claims`` with ``cited`` chunk ids per claim.
    """
    claims = F.coalesce("claims", F.array().cast(outcomes.schema["claims"].dataType))
    cited = F.array_distinct(F.flatten(F.transform(claims, lambda c: c["cited"])))
    expected = F.coalesce("expected_chunks", F.array().cast("array<string>"))
    present = F.col("outcome").isNotNull()
    return cases.join(outcomes.select("id", "outcome", "claims"), "id", "left").select(
        "id",
        "tags",
        (present & F.forall(claims, lambda c: F.size(c["cited"]) > 0)).alias("grounded"),
        (present & (F.size(F.array_except(expected, cited)) == 0)).alias("cited_expected"),
        F.col("outcome").eqNullSafe(F.col("expected_outcome")).alias("refusal_correct"),
    )


def _rates() -> list[Column]:
    return [
        F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)).alias(name)
        for name, flag in zip(
            THRESHOLDS, ("grounded", "cited_expected", "refusal_correct"), strict=True
        )
    ]


def evaluation_run(verdicts: DataFrame) -> DataFrame:
    """One row: metrics over all cases and whether every threshold is met."""
    passed = F.lit(True)
    for name, bar in THRESHOLDS.items():
        passed = passed & (F.col(name) >= bar)
    run = verdicts.agg(F.count(F.lit(1)).alias("case_count"), *_rates())
    return run.withColumn("status", F.when(passed, F.lit("passed")).otherwise(F.lit("failed")))


def tag_breakdown(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.withColumn("tag", F.explode("tags"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("case_count"), *_rates())
    )


def score_distribution(scores: DataFrame, probes: DataFrame, n_chunks: Column) -> DataFrame:
    """Per probe the statistics a gate could compare, over every chunk of the corpus.

    ``scores``: ``probe_id, score`` of the chunks that share something with the probe; all other
    chunks of the ``n_chunks`` score 0 and only enter the counts, so no zero row is made.
    ``probes``: ``probe_id, class``.
    """
    sums = scores.groupBy("probe_id").agg(
        F.max("score").alias("_best"),
        F.count(F.lit(1)).alias("_scored"),
        F.sum("score").alias("_sum"),
        F.sum(F.col("score") * F.col("score")).alias("_squares"),
    )
    # The runner-up comes from a two-row top-k, so no distribution is gathered in one place.
    top_two = top_k(
        scores.select("probe_id", "score"), ["probe_id"], [F.col("score").desc()], 2,
        fanout=default_fanout(scores),
    )
    second = top_two.filter(F.col("rank") == 2).select(
        "probe_id", F.col("score").alias("_second")
    )
    return summed_distribution(sums.join(second, "probe_id", "left"), probes, n_chunks)


def summed_distribution(sums: DataFrame, probes: DataFrame, n_chunks: Column) -> DataFrame:
    """``score_distribution`` from ``probe_id, _best, _scored, _sum, _squares, _second``."""
    listed = probes.join(sums, "probe_id", "left")
    zero = F.lit(0.0)
    # A chunk that is not listed scores 0, which can be the best or the runner-up.
    spare = n_chunks - F.coalesce("_scored", F.lit(0))
    mean = F.coalesce("_sum", zero) / n_chunks
    spread = F.coalesce("_squares", zero) / n_chunks - mean * mean
    best = F.when(F.col("_scored").isNull() | ((spare > 0) & (F.col("_best") < 0)), zero)
    best = best.otherwise(F.col("_best"))
    second_best = F.when(
        (F.coalesce("_scored", F.lit(0)) > 1) & ((spare <= 0) | (F.col("_second") > 0)),
        F.col("_second"),
    ).otherwise(zero)
    return listed.select(
        "probe_id",
        "class",
        best.alias("best"),
        mean.alias("mean"),
        F.sqrt(F.greatest(spread, zero)).alias("deviation"),
        second_best.alias("second"),
    )


def gate_separation(stats: DataFrame) -> DataFrame:
    """Lowest in-corpus minus highest out-of-corpus value, for each normalisation of the score."""
    forms = {
        "best": F.col("best"),
        "best_minus_mean": F.col("best") - F.col("mean"),
        "standard_score": F.when(F.col("deviation") == 0, F.lit(0.0)).otherwise(
            (F.col("best") - F.col("mean")) / F.col("deviation")
        ),
        "best_over_mean": F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(
            F.col("best") / F.col("mean")
        ),
        "best_minus_second": F.col("best") - F.col("second"),
        "mean": F.col("mean"),
    }
    pairs = [x for name, form in forms.items() for x in (F.lit(name), form)]
    values = stats.select("class", F.explode(F.create_map(*pairs)).alias("form", "value"))
    low = F.min(F.when(F.col("class") == "in-corpus", F.col("value")))
    high = F.max(F.when(F.col("class") == "out-of-corpus", F.col("value")))
    return values.groupBy("form").agg(F.round(low - high, 6).alias("separation"))
