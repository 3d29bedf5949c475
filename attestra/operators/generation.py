"""Prompts, extractive answers, claims and their validation, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.domain import (
    DEFAULT_EMBEDDING_MODEL,
    DEFAULT_PROMPT,
    EXTRACTIVE_PROFILE,
    MESSAGE_ANSWERED,
    MESSAGE_BLOCKED,
    MESSAGE_REFUSED,
    PromptTemplate,
    ProviderProfile,
)
from attestra.functions import hashing, text as T
from attestra.session import cut_lineage

# The prompt layout, the marker syntax and the limits of the extractive answerer.
QUESTION_MARK = "\nFrage:\n"
EVIDENCE_MARK = "\nEvidenz:\n"
MARKER_PATTERN = r"\[chunk:([A-Za-z0-9_-]+)\]"
CLAIM_PREFIX = "CLAIM: "
NO_EVIDENCE_ANSWER = "CLAIM: Keine ausreichende Evidenz im Korpus."
ECHO_ANSWER = "CLAIM: Die Antwort ist durch den Korpus belegt. [chunk:"
MAX_CLAIMS = 3

# A provider turns ``query_id, prompt, feedback`` into ``query_id, answer``. ``feedback`` holds the
# validation errors of the attempt before, null at the first one.
Provider = Callable[[DataFrame], DataFrame]


def render_prompt(
    query: Column, evidence: Column, template: PromptTemplate = DEFAULT_PROMPT
) -> Column:
    """``evidence`` is an array of structs with ``chunk_id`` and ``chunk_text``, in rank order."""
    lines = F.transform(
        evidence,
        lambda c: F.concat(F.lit("[chunk:"), c["chunk_id"], F.lit("] "), c["chunk_text"]),
    )
    return F.concat(
        F.lit(f"{template.body}\n{QUESTION_MARK}"),
        query,
        F.lit(f"\n{EVIDENCE_MARK}"),
        F.array_join(lines, "\n"),
    )


def prompts(
    queries: DataFrame, evidence: DataFrame, template: PromptTemplate = DEFAULT_PROMPT
) -> DataFrame:
    """One prompt per query; ``evidence`` holds at most ``top_k`` ranked chunks per query."""
    ranked = evidence.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chunk_text"))).alias("evidence")
    )
    empty = F.array().cast("array<struct<rank:int,chunk_id:string,chunk_text:string>>")
    joined = queries.join(ranked, "query_id", "left")
    return joined.select(
        "query_id",
        "query_text",
        render_prompt(F.col("query_text"), F.coalesce("evidence", empty), template).alias("prompt"),
    )


def _after(text: Column, mark: str) -> Column:
    """Text between the first and the second occurrence of a mark, null without one."""
    return F.try_element_at(F.split(text, mark), F.lit(2))


def prompt_sentences(prompts_frame: DataFrame) -> DataFrame:
    """Evidence sentences of each prompt with chunk and sentence position."""
    block = _after(F.col("prompt"), EVIDENCE_MARK)
    pieces = F.zip_with(
        F.regexp_extract_all(block, F.lit(MARKER_PATTERN), F.lit(1)),
        F.slice(F.split(block, MARKER_PATTERN), F.lit(2), F.lit(2**30)),
        lambda cid, body: F.struct(cid.alias("chunk_id"), T.sentences(body).alias("sentences")),
    )
    usable = F.filter(pieces, lambda p: F.size(p["sentences"]) > 0)
    chunks = prompts_frame.select("query_id", F.posexplode(usable).alias("chunk_rank", "c"))
    return chunks.select(
        "query_id",
        "chunk_rank",
        F.col("c.chunk_id").alias("chunk_id"),
        F.posexplode(F.col("c.sentences")).alias("sentence_rank", "sentence"),
    )


def sentence_scores(prompts_frame: DataFrame) -> DataFrame:
    """Share of the question's terms a sentence holds; repeated question terms count again."""
    question = F.split(F.coalesce(_after(F.col("prompt"), QUESTION_MARK), F.lit("")), "\n\n")[0]
    asked = prompts_frame.select("query_id", T.terms(question).alias("asked"))
    scored = prompt_sentences(prompts_frame).join(asked, "query_id").withColumn(
        "words", T.terms(F.col("sentence"))
    )
    hits = F.size(F.filter("asked", lambda t: F.array_contains(F.col("words"), t)))
    empty = (F.size("asked") == 0) | (F.size("words") == 0)
    score = F.when(empty, F.lit(0.0)).otherwise(F.round(hits / F.size("asked"), 6))
    return scored.select(
        "query_id", "chunk_id", "chunk_rank", "sentence_rank", "sentence", score.alias("score")
    )


def selected_sentences(prompts_frame: DataFrame) -> DataFrame:
    """Best three sentences with a positive score, else the first sentence of the evidence."""
    by_score = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("chunk_rank"), F.col("sentence_rank")
    )
    ranked = sentence_scores(prompts_frame).withColumn(
        "claim_rank", F.row_number().over(by_score).cast("int")
    )
    # Where no score is positive all are zero, so rank 1 is the first sentence of the first chunk.
    return ranked.filter(
        (F.col("claim_rank") <= MAX_CLAIMS) & ((F.col("score") > 0) | (F.col("claim_rank") == 1))
    )


def extractive_provider(prompts_frame: DataFrame) -> DataFrame:
    """Answers made only of lifted sentences, each tagged with its chunk."""
    line = F.concat(
        F.lit(CLAIM_PREFIX), "sentence", F.lit(" [chunk:"), "chunk_id", F.lit("]")
    )
    answers = selected_sentences(prompts_frame).groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("claim_rank", line.alias("line")))),
                lambda x: x["line"],
            ),
            "\n",
        ).alias("answer")
    )
    return prompts_frame.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(NO_EVIDENCE_ANSWER)).alias("answer")
    )


def echo_provider(prompts_frame: DataFrame) -> DataFrame:
    """A fixed statement that cites the first marker of the prompt."""
    first = F.regexp_extract(F.col("prompt"), MARKER_PATTERN, 1)
    cited = F.when(first == "", F.lit("missing")).otherwise(first)
    return prompts_frame.select(
        "query_id", F.concat(F.lit(ECHO_ANSWER), cited, F.lit("]")).alias("answer")
    )


def fixed_provider(outputs: list[str]) -> Provider:
    """Returns the outputs in turn, one per attempt; the last one repeats."""
    calls = {"n": 0}

    def provide(prompts_frame: DataFrame) -> DataFrame:
        text = outputs[min(calls["n"], len(outputs) - 1)] if outputs else ""
        calls["n"] += 1
        return prompts_frame.select("query_id", F.lit(text).alias("answer"))

    return provide


def parse_claims(answers: DataFrame) -> DataFrame:
    """``query_id, claim_index, claim_id, claim_text, cited`` — one row per non-empty line."""
    lines = F.filter(
        F.transform(F.split("answer", r"\n+"), lambda s: T.trim_unicode(s)), lambda s: s != ""
    )
    rows = answers.select("query_id", F.posexplode(lines).alias("claim_index", "line"))
    bare = F.regexp_replace("line", rf"{T.WHITESPACE}*\[chunk:[A-Za-z0-9_-]+\]", "")
    return rows.select(
        "query_id",
        "claim_index",
        hashing.stable_id("claim", F.col("claim_index"), F.col("line")).alias("claim_id"),
        T.trim_unicode(F.regexp_replace(bare, rf"(?i)^CLAIM:{T.WHITESPACE}*", "")).alias("claim_text"),
        F.regexp_extract_all("line", F.lit(MARKER_PATTERN), F.lit(1)).alias("cited"),
    )


def citations(claims: DataFrame) -> DataFrame:
    cited = F.filter("cited", lambda c: c != "")
    return claims.select(
        "query_id", "claim_index", F.posexplode(cited).alias("citation_index", "chunk_id")
    ).withColumn("marker", F.concat(F.lit("[chunk:"), "chunk_id", F.lit("]")))


def validate_claims(claims: DataFrame, evidence: DataFrame, snapshot_id: Column) -> DataFrame:
    """Validation errors: uncited claims, unknown chunks, chunks of another snapshot.

    ``evidence`` carries ``query_id, chunk_id, corpus_snapshot_id`` of the retrieved chunks.
    """
    listed = F.when(F.size("cited") == 0, F.array(F.lit(None).cast("string"))).otherwise(
        F.col("cited")
    )
    cited = claims.select(
        "query_id", "claim_index", F.posexplode(listed).alias("citation_index", "chunk_id")
    )
    known = evidence.select(
        "query_id", "chunk_id", F.col("corpus_snapshot_id").alias("_snapshot")
    )
    code = (
        F.when(F.col("chunk_id").isNull(), F.lit("missing_citation"))
        .when(F.col("_snapshot").isNull(), F.lit("invalid_chunk"))
        .when(F.col("_snapshot") != snapshot_id, F.lit("wrong_snapshot"))
    )
    return (
        cited.join(known, ["query_id", "chunk_id"], "left")
        .select(
            "query_id",
            "claim_index",
            "citation_index",
            code.alias("code"),
            F.coalesce("chunk_id", F.lit("claim has no citation")).alias("detail"),
        )
        .filter(F.col("code").isNotNull())
    )


def _attempt(
    prompts_frame: DataFrame, provider: Provider, evidence: DataFrame, snapshot_id: Column
) -> DataFrame:
    """One provider call per prompt with its claims and errors folded into arrays."""
    if "feedback" not in prompts_frame.columns:
        prompts_frame = prompts_frame.withColumn("feedback", F.lit(None).cast(ERRORS_TYPE))
    # Claims, errors and the attempt itself read the answers; a provider is asked once.
    answers = cut_lineage(provider(prompts_frame))
    claims = parse_claims(answers)
    claim_lists = claims.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("claim_index", "claim_id", "claim_text", "cited"))
        ).alias("claims")
    )
    error_lists = validate_claims(claims, evidence, snapshot_id).groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("claim_index", "citation_index", "code", "detail"))
        ).alias("errors")
    )
    return (
        answers.join(claim_lists, "query_id", "left")
        .join(error_lists, "query_id", "left")
        .select(
            "query_id",
            "answer",
            F.coalesce("claims", F.array().cast(CLAIMS_TYPE)).alias("claims"),
            F.coalesce("errors", F.array().cast(ERRORS_TYPE)).alias("errors"),
        )
    )


CLAIMS_TYPE = (
    "array<struct<claim_index:int,claim_id:string,claim_text:string,cited:array<string>>>"
)
ERRORS_TYPE = "array<struct<claim_index:int,citation_index:int,code:string,detail:string>>"


def attempts(
    prompt_rows: DataFrame,
    provider: Provider,
    evidence: DataFrame,
    snapshot_id: Column,
    deterministic: bool = True,
) -> DataFrame:
    """The last attempt at every prompt: ``query_id, answer, claims, errors``.

    An answer that fails validation is tried once more, with its errors as feedback. A deterministic
    provider that ignores feedback would repeat itself, so its second pass is left out.
    """
    first = _attempt(prompt_rows, provider, evidence, snapshot_id)
    if deterministic:
        return first
    # Both passes read the first attempt; stored, the joins of each attempt are a job of their own.
    first = cut_lineage(first)
    failing = first.filter(F.size("errors") > 0).select("query_id", F.col("errors").alias("feedback"))
    second = _attempt(prompt_rows.join(failing, "query_id"), provider, evidence, snapshot_id)
    return first.filter(F.size("errors") == 0).unionByName(cut_lineage(second))


def answer_outcomes(
    queries: DataFrame,
    gate: DataFrame,
    evidence: DataFrame,
    snapshot_id: Column,
    snapshot_hash: Column,
    provider: Provider = extractive_provider,
    profile: ProviderProfile = EXTRACTIVE_PROFILE,
    template: PromptTemplate = DEFAULT_PROMPT,
    deterministic: bool = True,
    embedding_model: str = DEFAULT_EMBEDDING_MODEL,
) -> DataFrame:
    """Refuse, answer, or block — one row per query.

    A refused query never reaches the provider. A failing answer is tried once more, with feedback,
    and blocked if it fails again.
    """
    asked = queries.join(gate.filter(~F.col("out_of_corpus")), "query_id", "left_semi")
    prompt_rows = prompts(asked, evidence, template)
    final = attempts(prompt_rows, provider, evidence, snapshot_id, deterministic)
    return outcome_rows(
        queries, gate, final, snapshot_id, snapshot_hash, profile, template, embedding_model
    )


def outcome_rows(
    queries: DataFrame,
    gate: DataFrame,
    attempts: DataFrame,
    snapshot_id: Column,
    snapshot_hash: Column,
    profile: ProviderProfile = EXTRACTIVE_PROFILE,
    template: PromptTemplate = DEFAULT_PROMPT,
    embedding_model: str = DEFAULT_EMBEDDING_MODEL,
) -> DataFrame:
    blocked = F.size(F.coalesce("errors", F.array().cast(ERRORS_TYPE))) > 0
    refused = F.col("out_of_corpus")
    outcome = (
        F.when(refused, F.lit("refused-out-of-corpus"))
        .when(blocked, F.lit("blocked-uncited"))
        .otherwise(F.lit("answered"))
    )
    answered = ~refused & ~blocked
    answer = F.when(answered, F.col("answer"))
    message = (
        F.when(refused, F.lit(MESSAGE_REFUSED))
        .when(blocked, F.lit(MESSAGE_BLOCKED))
        .otherwise(F.lit(MESSAGE_ANSWERED))
    )
    no_claims, no_errors = F.array().cast(CLAIMS_TYPE), F.array().cast(ERRORS_TYPE)
    return (
        queries.join(gate, "query_id")
        .join(attempts, "query_id", "left")
        .select(
            "query_id",
            "query_text",
            outcome.alias("outcome"),
            answer.alias("answer"),
            hashing.sha256_hex(answer).alias("answer_hash"),
            F.when(answered, F.col("claims")).otherwise(no_claims).alias("claims"),
            F.when(refused, no_errors)
            .otherwise(F.coalesce("errors", no_errors))
            .alias("validation_errors"),
            F.lit(profile.model_version).alias("model_version"),
            F.lit(template.version).alias("prompt_version"),
            F.lit(embedding_model).alias("embedding_model_version"),
            F.lit(profile.seed).cast("int").alias("seed"),
            F.lit(not profile.supports_seed).alias("seed_unsupported"),
            snapshot_id.alias("corpus_snapshot_id"),
            snapshot_hash.alias("corpus_snapshot_hash"),
            F.lit(profile.id).alias("provider_profile_id"),
            F.lit(profile.replay_capability).alias("provider_replay_capability"),
            F.lit(template.sha256).alias("prompt_hash"),
            message.alias("operator_message"),
        )
    )
