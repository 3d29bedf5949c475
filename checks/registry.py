"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.domain import EXTRACTIVE_PROFILE, ProviderProfile
from attestra.functions import canonical_json as J
from attestra.functions import hashing, html, redaction, text as T, vector
from attestra.functions.time import epoch_ms
from attestra.operators import chunking, dense, evaluation, fusion, generation, ledger, lexical
from attestra.operators import limits, replay, report, served, snapshots, topk
from attestra.operators.embedding import hash_embedding
from attestra.plans import answering, evaluating, retrieval, stored
from attestra.operators.topk import fits_broadcast
from attestra.session import checkpoint_directory, cut_lineage
from attestra.sources import fixtures, json_lines
from attestra.sources.snapshot_store import SnapshotStore
from attestra.sources.tables import read_table, read_text_table
from checks.constants import (
    ALLOWED_HOSTS,
    ENTRY_TYPES,
    SERVED_DIMENSION,
    SINCE,
    SNAPSHOT_HASH,
    SNAPSHOT_ID,
    UNTIL,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}



def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def as_text(name: str) -> Column:
    """Nullable numbers leave as text: data frames of the two engines type them differently."""
    return F.col(name).cast("string").alias(name)


# ---- inputs -------------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_text_table(spark, d, "documents", "doc_id", "source", "lang", "text")


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return chunking.revisions_from_documents(documents(spark, d))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return answering.corpus(revisions(spark, d), SNAPSHOT_ID)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        "event_id", "user_id", "event_type", epoch_ms(F.col("ts")).alias("ts_ms")
    )




def event_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The event log as ledger inputs, one ledger per user."""
    kinds = F.create_map(*[F.lit(x) for k, v in ENTRY_TYPES.items() for x in (k, v[0])])
    results = F.create_map(*[F.lit(x) for k, v in ENTRY_TYPES.items() for x in (k, v[1])])
    is_query = F.col("event_type").isin("view", "error", "purchase")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id").cast("string")
    return read_table(spark, d, "events").select(
        F.concat(F.lit("user-"), user).alias("ledger_id"),
        "event_id",
        kinds[F.col("event_type")].alias("entry_type"),
        results[F.col("event_type")].alias("outcome"),
        F.when(is_query, F.concat(F.lit('Was gilt für "'), F.col("event_id").cast("string"),
                                  F.lit('"?'))).alias("query_text"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("generated_answer"),
        F.when(is_query, F.concat(F.lit("model-"), (k % 3).cast("string"))).alias("model_version"),
        F.when(is_query, F.lit(42)).alias("seed"),
        hashing.sha256_hex(user).alias("user_id_hash"),
        epoch_ms(F.col("ts")).alias("timestamp_ms"),
        J.canonical_json("props").alias("metadata"),
    )


def event_entries(spark: SparkSession, d: str) -> DataFrame:
    return ledger.append_entries(event_inputs(spark, d), ["timestamp_ms", "event_id"])


def answered(spark: SparkSession, d: str):
    return answering.answer_queries(
        revisions(spark, d), questions(spark, d), SNAPSHOT_ID, SNAPSHOT_HASH
    )


# ---- text, hashes, redaction --------------------------------------------------------------------


@query
def text_terms(spark, d):
    terms = documents(spark, d).select("doc_id", T.terms(F.col("text")).alias("t"))
    return terms.select(
        "doc_id",
        F.size("t").alias("n_terms"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
        F.sha2(F.array_join("t", "|"), 256).alias("terms_sha256"),
    )


@query
def normalized_text(spark, d):
    return documents(spark, d).select(
        "doc_id", T.normalize_text(F.col("text")).alias("t")
    ).select(
        "doc_id",
        F.sha2("t", 256).alias("text_sha256"),
        T.utf16_length(F.col("t")).alias("utf16_length"),
    )


@query
def extraction_flags(spark, d):
    kind = F.when(F.col("lang") == "de", F.lit("pdf")).otherwise(F.lit("markdown"))
    pages = read_text_table(spark, d, "pages").select(
        F.concat(F.lit("page/"), "page_id").alias("source_path"),
        F.col("html").alias("text"),
        F.lit("markdown").alias("source_type"),
    )
    docs = documents(spark, d).select(
        F.concat_ws("/", "source", "doc_id").alias("source_path"), "text", kind.alias("source_type")
    )
    warnings = T.extraction_warnings(F.col("text"), F.col("source_type"))
    return docs.unionByName(pages).select(
        "source_path",
        "source_type",
        F.array_join(warnings, ",").alias("warnings"),
        T.scanned_pdf(F.col("text"), F.col("source_type")).alias("ocr_used"),
    )


@query
def document_identity(spark, d):
    return revisions(spark, d).select(
        "source_path",
        "content_sha256",
        hashing.short_hash(F.col("content_sha256")).alias("short_hash"),
        hashing.stable_id("doc", F.col("source_path")).alias("doc_key"),
        hashing.stable_id("src", F.col("source_path")).alias("source_key"),
    )


@query
def word_xml_text(spark, d):
    flat = T.word_xml_to_text(F.col("html"))
    return read_text_table(spark, d, "pages").select("page_id", flat.alias("t")).select(
        "page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").alias("n_chars")
    )


@query
def html_article(spark, d):
    body = html.article_body(F.col("v"), r"\S", "&copy;")
    return (
        read_text_table(spark, d, "pages")
        .select("page_id", html.visible_text(F.col("html")).alias("v"))
        .select("page_id", "v", body.alias("b"))
        .select(
            "page_id",
            F.sha2("v", 256).alias("visible_sha256"),
            F.sha2("b.body", 256).alias("body_sha256"),
            F.col("b.problem").alias("problem"),
        )
    )


@query
def secret_scan(spark, d):
    texts = documents(spark, d).select(F.lit("documents").alias("origin"), "text").unionByName(
        read_text_table(spark, d, "conversations").select(
            F.lit("conversations").alias("origin"), "text"
        )
    )
    return texts.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count(F.when(redaction.has_prompt_secret(F.col("text")), 1)).alias("n_secrets"),
    )


@query
def egress_check(spark, d):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    return read_table(spark, d, "pages").select("page_id", host.alias("host")).select(
        "page_id", "host", redaction.egress_allowed(F.col("host"), ALLOWED_HOSTS).alias("allowed")
    )


def _event_meta():
    return F.create_map(
        *[x for k, v in {
            "query": F.col("props"),
            "query_id": F.col("event_id").cast("string"),
            "latencyMs": F.col("value").cast("int").cast("string"),
            "userIdHash": F.sha2(F.col("user_id").cast("string"), 256),
            "outcome": F.col("event_type"),
            "answer_text": F.col("props"),
            "providerApiKey": F.col("event_type"),
        }.items() for x in (F.lit(k), v)]
    )


@query
def operational_log(spark, d):
    meta = _event_meta()
    return read_table(spark, d, "events").select(
        "event_id",
        F.array_join(F.map_values(redaction.redact_map(meta)), "|").alias("redacted"),
        redaction.operational_info(meta).alias("i"),
    ).select("event_id", "redacted", "i.user_id_hash", "i.query_id", "i.latency_ms", "i.outcome")


@query
def redact_nested(spark, d):
    raw = F.concat(
        F.lit('{"query":"q","nested":{"db_credential":'), "props",
        F.lit('},"items":[{"password":1,"keep":'), "props", F.lit('},7,["pii"]],"n":'),
        F.col("event_id").cast("string"), F.lit("}"),
    )
    return read_table(spark, d, "events").select(
        "event_id", redaction.redact_json(raw).alias("redacted")
    )


@query
def canonical_properties(spark, d):
    raw = F.concat(
        F.lit('{ "z": [1.50, null, true], "props": '), "props", F.lit(', "a": '),
        F.col("event_id").cast("string"), F.lit(".0 }"),
    )
    return read_table(spark, d, "events").select(
        "event_id", J.canonical_json(raw).alias("canonical")
    )


# ---- vectors ------------------------------------------------------------------------------------


@query
def vector_literals(spark, d):
    return read_table(spark, d, "embeddings").select(
        "vec_id", F.sha2(vector.vector_literal(F.col("embedding")), 256).alias("literal_sha256")
    )


@query
def vector_validation(spark, d):
    broken = (
        F.when(F.col("label") == 1, F.transform("embedding", lambda x: x * F.lit(0.0)))
        .when(F.col("label") == 2, F.transform("embedding", lambda x: x / x * F.lit(float("nan"))))
        .when(F.col("label") == 3, F.slice("embedding", 1, 10).cast("array<double>"))
        .otherwise(F.col("embedding").cast("array<double>"))
    )
    return read_table(spark, d, "embeddings").select(
        "vec_id", vector.vector_problem(broken, 64).alias("problem")
    )


def _centroids(embeddings: DataFrame) -> DataFrame:
    cells = embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("x"))
    return means.groupBy("label").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]
        ).alias("vector")
    )


@query
def label_cosine(spark, d):
    embeddings = read_table(spark, d, "embeddings")
    own = embeddings.join(_centroids(embeddings), "label")
    return own.select(
        "vec_id",
        "label",
        F.round(vector.cosine_similarity(F.col("embedding"), F.col("vector")), 6).alias("cosine"),
    )


@query
def dense_top_k(spark, d):
    embeddings = read_table(spark, d, "embeddings")
    asked = _centroids(embeddings).select(F.col("label").alias("query_id"), "vector")
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dense.cosine_top_k(vectors, asked).select("query_id", "rank", "id", "score")


@query
def hash_embedding_cells(spark, d):
    embedded = documents(spark, d).select(
        "doc_id", hash_embedding(F.col("text"), 16).alias("v")
    )
    return embedded.select("doc_id", F.posexplode("v").alias("cell", "x")).select(
        "doc_id", "cell", F.round("x", 6).alias("value")
    )


@query
def index_size(spark, d):
    counted = corpus(spark, d).agg(F.count(F.lit(1)).alias("chunk_count"))
    return counted.select(
        "chunk_count", vector.estimated_index_bytes(F.col("chunk_count")).alias("index_bytes")
    )


@query
def embedding_cache_lookup(spark, d):
    """Vectors addressed by the hash of the text; a miss shows as such."""
    cached = documents(spark, d).select(F.sha2("text", 256).alias("text_sha256"), "lang").groupBy(
        "text_sha256"
    ).agg(F.count(F.lit(1)).alias("copies"))
    asked = documents(spark, d).select("doc_id", F.sha2("text", 256).alias("text_sha256")).unionByName(
        questions(spark, d).select(
            (-F.col("query_id") - 1).alias("doc_id"), F.sha2("query_text", 256).alias("text_sha256")
        )
    )
    return asked.join(cached, "text_sha256", "left").select(
        "doc_id", as_text("copies"), F.col("copies").isNull().alias("miss")
    )


# ---- corpus -------------------------------------------------------------------------------------


@query
def corpus_snapshot(spark, d):
    return snapshots.snapshot_row(revisions(spark, d), 1)


@query
def ingest_events(spark, d):
    """The ledger row an ingest of the documents leaves."""
    inputs = snapshots.ingest_events(
        snapshots.snapshot_row(revisions(spark, d), 1), F.lit("main"), F.lit(1_700_000_000_000)
    )
    return ledger.append_entries(inputs, ["append_order"]).select(
        "sequence", "entry_type", "outcome", "embedding_model_version", "corpus_snapshot_id",
        "corpus_snapshot_hash", "user_id_hash", "metadata", "model_version",
    )


def stored_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots, English documents first and all others later, and one that failed."""
    english = F.col("lang") == "en"
    listed = documents(spark, d).groupBy(
        F.when(english, F.lit("older")).when(F.col("lang") == "de", F.lit("failed"))
        .otherwise(F.lit("current")).alias("id")
    ).agg(F.count(F.lit(1)).alias("document_count"))
    sequence = F.when(F.col("id") == "older", 1).when(F.col("id") == "current", 2).otherwise(3)
    status = F.when(F.col("id") == "failed", F.lit("failed")).otherwise(F.lit("active"))
    return listed.withColumn("sequence", sequence).withColumn("status", status)


@query
def next_sequence(spark, d):
    return snapshots.next_sequence(stored_snapshots(spark, d))


@query
def active_snapshot_ranking(spark, d):
    """Rankings over the active snapshot of a chunk table that holds all three."""
    found = documents(spark, d)
    held = None
    for name, chosen in (
        ("older", F.col("lang") == "en"),
        ("failed", F.col("lang") == "de"),
        ("current", ~F.col("lang").isin("en", "de")),
    ):
        part = answering.corpus(
            chunking.revisions_from_documents(found.filter(chosen)), SNAPSHOT_ID
        ).withColumn("corpus_snapshot_id", F.lit(name))
        held = part if held is None else held.unionByName(part)
    active = snapshots.active_snapshot(stored_snapshots(spark, d)).first()["id"]
    return lexical.lexical_candidates(
        retrieval.active_chunks(held, active), questions(spark, d)
    ).select("query_id", "method", "rank", "chunk_id", "score")


@query
def corpus_snapshot_flat(spark, d):
    return snapshots.snapshot_row(revisions(spark, d), 1, kind=snapshots.FLAT)


@query
def chunk_records(spark, d):
    found = revisions(spark, d)
    records = chunking.chunk_records(
        chunking.token_windows_with_offsets(found), F.lit(SNAPSHOT_ID), F.lit(SNAPSHOT_HASH)
    )
    return records.select(
        "chunk_id", "doc_id", "source_document_id", "source_type", "source_path", "page_start",
        "page_end", "char_start", "char_end", "token_start", "token_end", "chunk_index",
        "chunk_sha256", "corpus_snapshot_id", "corpus_snapshot_hash",
        F.array_join("extraction_warnings", ",").alias("extraction_warnings"), "ocr_used",
    )


def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents are already stored; those labelled toxic with an older text."""
    old = F.when(F.col("toxic") == 1, F.lower("text")).otherwise(F.col("text"))
    return documents(spark, d).join(read_table(spark, d, "labels"), "doc_id").select(
        F.concat_ws("/", "source", "doc_id").alias("source_path"),
        F.sha2(old, 256).alias("content_sha256"),
    )


@query
def changed_documents(spark, d):
    return snapshots.changed_revisions(revisions(spark, d), stored_hashes(spark, d)).select(
        "source_path", "content_sha256"
    )


@query
def ingest_summary(spark, d):
    return snapshots.ingest_summary(revisions(spark, d), stored_hashes(spark, d))


@query
def ingest_no_op(spark, d):
    found = revisions(spark, d)
    return snapshots.ingest_summary(found, found.select("source_path", "content_sha256"))


def hand_made_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one chunk."""
    return documents(spark, d).select(
        F.concat_ws("/", "source", "doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")
    )


@query
def corpus_manifest_hash(spark, d):
    return snapshots.fixture_corpus_hash(hand_made_chunks(spark, d))


@query
def corpus_manifest_hash_flat(spark, d):
    return snapshots.fixture_corpus_hash(hand_made_chunks(spark, d), kind=snapshots.FLAT)


@query
def chunk_provenance(spark, d):
    """Paragraphs of each page-like document against its text; every seventh paragraph is altered."""
    docs = documents(spark, d).select(F.col("doc_id").alias("source_id"), "text")
    parts = docs.select("source_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "p"))
    changed = F.when(F.col("chunk_index") % 7 == 6, F.concat("p", F.lit("~"))).otherwise(F.col("p"))
    chunks = parts.filter(F.col("p") != "").select(
        "source_id", "chunk_index", changed.alias("chunk_text")
    )
    return snapshots.provenance(docs, chunks)


@query
def source_spans(spark, d):
    """First chunk of every document that starts at or after character 2000."""
    windows = chunking.token_windows_with_offsets(revisions(spark, d))
    return windows.filter(F.col("char_start") >= 2000).groupBy("source_path").agg(
        F.min("chunk_index").alias("chunk_index")
    )


@query
def source_span_lookup(spark, d):
    """Every thousandth character of every document as a request for its source chunk."""
    found = revisions(spark, d)
    chunks = chunking.chunk_records(
        chunking.token_windows_with_offsets(found), F.lit(SNAPSHOT_ID), F.lit(SNAPSHOT_HASH)
    )
    offsets = F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(1000))).alias("offset")
    requests = found.select(hashing.stable_id("doc", F.col("source_path")).alias("doc_id"), "source_path", offsets)
    return retrieval.find_source_chunks(chunks, requests).select(
        "source_path", "offset", "chunk_id", as_text("chunk_index"), as_text("char_start")
    )


@query
def pinned_sources(spark, d):
    """Pages as retrieved sources; the recorded hash of some is that of another text."""
    text = F.when(F.col("page_id") % 6 == 1, F.lower("html")).otherwise(F.col("html"))
    day = F.when(F.col("page_id") % 5 == 2, F.lit("yesterday")).otherwise(F.lit("2026-05-01"))
    sources = read_text_table(spark, d, "pages").select(
        F.col("page_id").alias("source_id"), F.col("html").alias("text"), F.sha2(text, 256).alias("recorded_sha256"),
        F.col("url").alias("retrieval_url"), day.alias("retrieved_at"),
    )
    return snapshots.pinned_sources(sources)


@query
def marked_chunks(spark, d):
    """Text after each comment marker of a page, as a hand-chunked file would be read."""
    files = read_text_table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("source_path"), F.col("html").alias("text")
    )
    chunks = fixtures.parse_fixture_chunks(files, r"<!--\s*ad ([0-9]+)\s*-->")
    return chunks.select(
        "source_path", "chunk_index", "chunk_id", F.sha2("chunk_text", 256).alias("text_sha256")
    )


@query
def repeated_chunk_ids(spark, d):
    """Chunk ids used more than once: here lines of documents named by their hash."""
    lines = documents(spark, d).select(F.explode(F.split("text", "\n")).alias("chunk_text"))
    named = lines.filter(F.col("chunk_text") != "").select(F.sha2("chunk_text", 256).alias("chunk_id"))
    return fixtures.duplicate_chunk_ids(named)


# ---- ranking ------------------------------------------------------------------------------------


@query
def term_weights(spark, d):
    return lexical.corpus_term_weights(corpus(spark, d))


@query
def lexical_candidates(spark, d):
    return lexical.lexical_candidates(corpus(spark, d), questions(spark, d)).select(
        "query_id", "method", "rank", "chunk_id", "score"
    )


@query
def fused_ranking(spark, d):
    found = retrieval.retrieve(corpus(spark, d), questions(spark, d), trace=True)
    return found.fused.select("query_id", "rank", "chunk_id", "score", "evidence")


@query
def cited_evidence(spark, d):
    found = retrieval.retrieve(corpus(spark, d), questions(spark, d))
    return found.evidence.select("query_id", "rank", "chunk_id", "score", "evidence")


@query
def evidence_bars(spark, d):
    found = retrieval.retrieve(corpus(spark, d), questions(spark, d))
    return retrieval.evidence_bars(found.evidence).select("query_id", "rank", "chunk_id", "bar")


@query
def refusal_gate(spark, d):
    found = retrieval.retrieve(corpus(spark, d), questions(spark, d), trace=True)
    return found.gate


@query
def semantic_retrieval(spark, d):
    """Hash-embedding cosine in place of the lexical stand-in; the gate stays lexical."""
    chunks, asked = corpus(spark, d), questions(spark, d)
    scores = retrieval.hash_dense_scores(chunks, asked, SERVED_DIMENSION).withColumn(
        "source_path", F.lit(None).cast("string")
    )
    bare = chunks.withColumn("source_path", F.lit(None).cast("string"))
    found = retrieval.retrieve(bare, asked, dense_scores=scores)
    return found.evidence.select("query_id", "rank", "chunk_id", "score", "evidence")


@query
def supplied_scores(spark, d):
    """A ranking by supplied scores: steps of a tenth, so many tie, and many are negative; chunks
    beyond a question's 50 best have none."""
    chunks, asked = corpus(spark, d), questions(spark, d)
    scores = retrieval.hash_dense_scores(chunks, asked, SERVED_DIMENSION).select(
        "query_id", "chunk_id", F.lit(None).cast("string").alias("source_path"),
        (F.floor((F.col("score") - 0.35) * 10) / 10).alias("score"),
    )
    bare = chunks.withColumn("source_path", F.lit(None).cast("string"))
    return retrieval.dense_candidates(scores, bare, asked, lexical.CANDIDATE_LIMIT).select(
        "query_id", "rank", "chunk_id", "score"
    )


@query
def served_terms_ranking(spark, d):
    return served.all_terms_candidates(corpus(spark, d), questions(spark, d)).select(
        "query_id", "rank", "chunk_id", "score"
    )


@query
def served_dense_ranking(spark, d):
    return retrieval.hash_dense_scores(
        corpus(spark, d), questions(spark, d), SERVED_DIMENSION
    ).select("query_id", "rank", "chunk_id", "score")


def text_cache(spark: SparkSession, d: str) -> DataFrame:
    """A vector cache of all chunk texts and the questions with an even id."""
    asked = questions(spark, d).filter("query_id % 2 = 0").select(F.col("query_text").alias("text"))
    texts = corpus(spark, d).select(F.col("chunk_text").alias("text")).unionByName(asked).distinct()
    return texts.select(
        F.sha2("text", 256).alias("text_sha256"), hash_embedding(F.col("text"), SERVED_DIMENSION).alias("vector")
    )


@query
def cached_dense_ranking(spark, d):
    """Every vector comes from the cache; a text it lacks would fail the job."""
    cache = cut_lineage(text_cache(spark, d))
    chunks = corpus(spark, d).select(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text"))
    asked = questions(spark, d).filter("query_id % 2 = 0").withColumnRenamed("query_text", "text")
    found = dense.cosine_top_k(
        json_lines.lookup_vectors(chunks, cache).select("id", "vector"),
        json_lines.lookup_vectors(asked, cache).select("query_id", "vector"),
        lexical.CANDIDATE_LIMIT,
        strict=False,
    )
    return found.withColumnRenamed("id", "chunk_id").select("query_id", "rank", "chunk_id", "score")


@query
def cache_misses(spark, d):
    asked = questions(spark, d).withColumnRenamed("query_text", "text")
    return json_lines.cache_misses(asked, text_cache(spark, d)).select("query_id", "text_sha256")


@query
def unusable_scores(spark, d):
    """Fusion and gate where some scores are no numbers or infinite."""
    spoiled = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 11 == 0, F.lit(float("inf"))
    ).when(F.col("event_id") % 13 == 0, F.lit(float("-inf"))).when(F.col("event_id") % 17 == 0, F.lit(None))
    scored = read_table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_type").alias("method"),
        F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("chunk_id"),
        F.lit(None).cast("string").alias("source_path"),
        F.when((F.col("event_id") % 7 == 0) | (F.col("event_id") % 11 == 0) | (F.col("event_id") % 13 == 0)
               | (F.col("event_id") % 17 == 0), spoiled).otherwise(F.round("value", 6)).alias("score"),
    )
    ranked = topk.rank_within(
        fusion.finite_candidates(scored), ["query_id", "method"], lexical.candidate_order(), "rank"
    )
    gate = fusion.served_gate(scored.select("query_id").distinct(), scored)
    return fusion.reciprocal_rank_fusion(ranked).join(gate, "query_id").select(
        "query_id", "chunk_id", "rank", "score", "best_evidence", "out_of_corpus"
    )


@query
def served_retrieval(spark, d):
    found = retrieval.retrieve_served(corpus(spark, d), questions(spark, d), SERVED_DIMENSION)
    return found.evidence.select("query_id", "rank", "chunk_id", "score")


# ---- stored snapshots ---------------------------------------------------------------------------


STORES: dict[tuple[str, str], SnapshotStore] = {}


def snapshot_store(spark: SparkSession, d: str) -> SnapshotStore:
    """A store in the shared folder with two ingests: English documents, then all of them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in STORES:
        store = SnapshotStore(spark, f"{checkpoint_directory(spark)}/store-{uuid.uuid4().hex}")
        found = documents(spark, d)
        for part in (found.filter(F.col("lang") == "en"), found):
            store.ingest(chunking.revisions_from_documents(part), dimension=SERVED_DIMENSION)
        STORES[key] = store
    return STORES[key]


@query
def stored_snapshots_listing(spark, d):
    return snapshot_store(spark, d).snapshots().select(
        "sequence", "id", "snapshot_hash", "status", "document_count", "chunk_count"
    )


@query
def stored_chunks(spark, d):
    """Chunk records of the active snapshot as they were stored."""
    return snapshot_store(spark, d).open().chunks().select(
        "chunk_id", "source_path", "chunk_index", "char_start", "char_end", "chunk_sha256",
        "corpus_snapshot_id", "corpus_snapshot_hash",
    )


@query
def stored_retrieval(spark, d):
    """Cited evidence from stored postings of the active snapshot."""
    found = stored.retrieve_stored(snapshot_store(spark, d).open(), questions(spark, d))
    return found.evidence.select("query_id", "rank", "chunk_id", "score", "evidence")


@query
def stored_older_retrieval(spark, d):
    """The same from the older snapshot; nothing of the newer one shows."""
    store = snapshot_store(spark, d)
    older = store.snapshots().filter("sequence = 1").first()["id"]
    found = stored.retrieve_stored(store.open(older), questions(spark, d))
    return found.evidence.select("query_id", "rank", "chunk_id", "score", "evidence")


@query
def stored_served_retrieval(spark, d):
    """Stored vectors, all cells probed, and stored positions."""
    corpus = snapshot_store(spark, d).open()
    found = stored.retrieve_served_stored(corpus, questions(spark, d), probes=corpus.cells().count())
    return found.evidence.select("query_id", "rank", "chunk_id", "score")


# ---- answers ------------------------------------------------------------------------------------


@query
def cited_answers(spark, d):
    outcomes, _, _ = answered(spark, d)
    return outcomes.select(
        "query_id", "outcome", "answer", "answer_hash", F.size("claims").alias("n_claims"),
        F.size("validation_errors").alias("n_errors"), "model_version", "prompt_version", "seed",
        "provider_profile_id", "prompt_hash", "operator_message",
    )


def hesitant_provider(prompts: DataFrame) -> DataFrame:
    """Cites nothing at first; told so, it cites for even questions and stays as it was for odd ones."""
    cited = generation.echo_provider(prompts).withColumnRenamed("answer", "cited")
    told = F.size(F.coalesce("feedback", F.array().cast(generation.ERRORS_TYPE))) > 0
    return prompts.join(cited, "query_id").select(
        "query_id",
        F.when(told & (F.col("query_id") % 2 == 0), F.col("cited"))
        .otherwise(F.lit("CLAIM: Ohne Beleg."))
        .alias("answer"),
    )


@query
def blocked_answers(spark, d):
    outcomes, _, _ = answering.answer_queries(
        revisions(spark, d), questions(spark, d), SNAPSHOT_ID, SNAPSHOT_HASH,
        provider=hesitant_provider, deterministic=False,
    )
    errors = F.transform("validation_errors", lambda e: e["code"])
    return outcomes.select(
        "query_id", "outcome", "answer", F.array_join(errors, ",").alias("errors"),
        F.size("claims").alias("n_claims"),
    )


@query
def echo_answers(spark, d):
    outcomes, _, _ = answering.answer_queries(
        revisions(spark, d), questions(spark, d), SNAPSHOT_ID, SNAPSHOT_HASH,
        provider=generation.echo_provider,
    )
    return outcomes.select("query_id", "outcome", "answer")


def conversation_answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as answers whose lines cite turn numbers of the same conversation."""
    turns = read_text_table(spark, d, "conversations")
    cited = F.concat(F.lit(" [chunk:turn-"), (F.col("turn") - 1).cast("string"), F.lit("]"))
    marked = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.when(i % 3 == 2, line).otherwise(F.concat(line, cited)),
        ),
        "\n",
    )
    key = F.concat_ws("-", "conv_id", "turn")
    return turns.filter(F.col("role") == "assistant").select(key.alias("query_id"), marked.alias("answer"))


@query
def parsed_claims(spark, d):
    claims = generation.parse_claims(conversation_answers(spark, d))
    return claims.select(
        "query_id", "claim_index", "claim_id", F.sha2("claim_text", 256).alias("text_sha256"),
        F.array_join("cited", ",").alias("cited"),
    )


@query
def claim_errors(spark, d):
    claims = generation.parse_claims(conversation_answers(spark, d))
    turns = read_table(spark, d, "conversations").select("conv_id", "turn", "role")
    asked = turns.filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("query_id"),
        F.concat(F.lit("turn-"), "turn").alias("chunk_id"),
        F.when(F.col("turn") == 0, F.lit("first")).otherwise(F.lit("later")).alias(
            "corpus_snapshot_id"
        ),
    )
    return generation.validate_claims(claims, asked, F.lit("first")).select(
        "query_id", "claim_index", "code", "detail"
    )


# ---- ledger -------------------------------------------------------------------------------------


@query
def ledger_append(spark, d):
    return event_entries(spark, d).select(
        "ledger_id", "sequence", "event_id", "previous_hash", "id", "query_sha256",
        F.sha2("canonical_payload", 256).alias("payload_sha256"),
    )


def signed_entries(spark: SparkSession, d: str) -> DataFrame:
    return event_entries(spark, d).withColumn("signature", F.substring("id", 1, 16))


def verdicts(entries: DataFrame) -> DataFrame:
    return ledger.verify_entries(entries).select(
        "ledger_id", "ok", "checked_rows", as_text("first_invalid_sequence"), "reason"
    )


def tampered_entries(spark: SparkSession, d: str) -> DataFrame:
    """Four kinds of tampering, each on the rows of some users."""
    entries = signed_entries(spark, d)
    third = F.col("sequence") == 3
    kind = F.pmod(F.substring("ledger_id", 6, 20).cast("bigint"), F.lit(5))
    changed = ledger.tampered(
        entries, third & (kind == 1), {"outcome": F.lit("provider-error")}
    )
    changed = ledger.tampered(changed, third & (kind == 2), {"previous_hash": F.lit("0" * 64)})
    changed = ledger.tampered(changed, third & (kind == 3), {"id": F.lit("f" * 64)})
    return ledger.tampered(changed, third & (kind == 4), {"signature": F.lit("")})


@query
def ledger_verify(spark, d):
    return verdicts(signed_entries(spark, d))


@query
def ledger_verify_tampered(spark, d):
    return verdicts(tampered_entries(spark, d))


@query
def ledger_verify_incremental(spark, d):
    """Rows behind a mark only. Two kinds of tampering: at a ledger's beginning, which a mark hides,
    and at the first row behind the mark, which is found."""
    cutoff, _ = report.parse_window(SINCE, UNTIL)
    inputs = event_inputs(spark, d)
    order = ["timestamp_ms", "event_id"]
    before = ledger.append_entries(inputs.filter(F.col("timestamp_ms") < cutoff), order)
    marks = cut_lineage(ledger.ledger_heads(before))
    after = ledger.append_entries(inputs.filter(F.col("timestamp_ms") >= cutoff), order, marks)
    entries = before.unionByName(after).withColumn("signature", F.substring("id", 1, 16))
    kind = F.pmod(F.substring("ledger_id", 6, 20).cast("bigint"), F.lit(3))
    first = entries.join(
        marks.select("ledger_id", (F.col("last_sequence") + 1).alias("_fresh")), "ledger_id", "left"
    )
    at = F.when(kind == 1, F.lit(1)).otherwise(F.coalesce("_fresh", F.lit(1)))
    changed = ledger.tampered(
        first, (kind > 0) & (F.col("sequence") == at), {"outcome": F.lit("provider-error")}
    ).drop("_fresh")
    return ledger.verify_after(changed, marks).select(
        "ledger_id", "ok", "checked_rows", as_text("first_invalid_sequence"), "reason"
    )


@query
def ledger_window(spark, d):
    start, end = report.parse_window(SINCE, UNTIL)
    inputs = ledger.normalize_entries(event_inputs(spark, d))
    return ledger.window_entries(inputs, start, end, ("replay.passed",)).select(
        "event_id", "ledger_id", "entry_type", "model_version", "prompt_version",
        "provider_replay_capability", "generated_answer_sha256", as_text("seed"), "timestamp_ms",
        report.iso_from_ms_column(F.col("timestamp_ms")).alias("timestamp_iso"),
    )


@query
def retention_view(spark, d):
    deleted = read_table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("m")).filter(
        F.col("m") > 300
    )
    user = F.col("user_id").cast("string")
    tombstones = deleted.select(
        F.sha2(user, 256).alias("user_id_hash"),
        F.sha2(F.concat(user, F.lit(":deleted")), 256).alias("tombstone_hash"),
    )
    return ledger.retention_view(event_inputs(spark, d), tombstones).select(
        "event_id", "user_id_hash", "metadata"
    )


@query
def report_facts(spark, d):
    facts = report.report_facts(
        ledger.normalize_entries(event_inputs(spark, d)), SINCE, UNTIL
    )
    return facts.select(
        "since", "until",
        *[F.array_join(c, ",").alias(c) for c in report.VERSION_COLUMNS],
        "query_volume", F.round("refusal_rate", 6).alias("refusal_rate"),
    )


@query
def outcome_breakdown(spark, d):
    start, end = report.parse_window(SINCE, UNTIL)
    return report.outcome_breakdown(ledger.window_entries(event_inputs(spark, d), start, end))


@query
def health(spark, d):
    return report.health(event_inputs(spark, d), corpus(spark, d))


def query_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger rows the answered questions leave, chunks included."""
    outcomes, _, found = answered(spark, d)
    records = retrieval.fetch_chunk_records(
        revisions(spark, d),
        found.evidence.select("query_id", "rank", "chunk_id", "source_path", "score"),
        SNAPSHOT_ID,
        SNAPSHOT_HASH,
    )
    inputs = answering.query_ledger_inputs(outcomes, records, "queries", "u" * 64, "session", 1_700_000_000_000)
    return cut_lineage(ledger.append_entries(inputs, ["append_order"]))


def replay_results(
    spark: SparkSession, d: str, profile: ProviderProfile = EXTRACTIVE_PROFILE
) -> DataFrame:
    """Ledger rows, some altered or recorded under other artifacts, replayed from what they hold."""
    q = F.col("append_order")
    altered = F.when(q % 7 == 3, F.concat("generated_answer", F.lit(" "))).otherwise(
        F.col("generated_answer")
    )

    def older(k: int, column: str) -> Column:
        return F.when(q % 5 == k, F.lit("older")).otherwise(F.col(column))

    entries = query_ledger(spark, d).withColumns(
        {
            "id": q.cast("string"),
            "generated_answer": altered,
            "generated_answer_sha256": hashing.sha256_hex(altered),
            "corpus_snapshot_hash": older(1, "corpus_snapshot_hash"),
            "prompt_hash": older(2, "prompt_hash"),
            "embedding_model_version": older(3, "embedding_model_version"),
            "model_version": older(4, "model_version"),
        }
    )
    artifacts = replay.ReplayArtifacts(
        F.when(q_id() % 2 == 0, F.col("corpus_snapshot_hash")).otherwise(F.lit(SNAPSHOT_HASH)),
        F.lit(generation.DEFAULT_PROMPT.sha256),
        F.lit(generation.DEFAULT_EMBEDDING_MODEL),
        F.lit(generation.EXTRACTIVE_PROFILE.model_version),
    )
    return replay.replay_entries(entries, artifacts, profile=profile)


def q_id():
    return F.col("id").cast("bigint")


@query
def replay_status(spark, d):
    return replay_results(spark, d).select(
        "id", "status", F.col("byte_equal").cast("string").alias("byte_equal"), "drift_artifact",
        "generated_answer_sha256",
        "regenerated_answer_sha256", "operator_message",
    )


@query
def replay_from_ledger(spark, d):
    """The same rows under a profile that supports replay and under one that does not."""
    none = ProviderProfile("hosted", "hosted", "hosted@1", "unsupported", False)
    columns = ["id", "status", F.col("byte_equal").cast("string").alias("byte_equal"), "drift_artifact"]
    supported = replay_results(spark, d).select(F.lit("supported").alias("profile"), *columns)
    return supported.unionByName(
        replay_results(spark, d, none).select(F.lit("unsupported").alias("profile"), *columns)
    )


# ---- evaluation ---------------------------------------------------------------------------------


@query
def replay_pairs(spark, d):
    """Every click as the replay of the event before it, which is an answer, another replay or neither."""
    events = read_table(spark, d, "events")
    name = lambda c: F.sha2(c.cast("string"), 256)
    answered_rows = events.filter("event_type = 'view'").select(
        name(F.col("event_id")).alias("id"), F.lit("query.answered").alias("entry_type"),
        F.lit("answered").alias("outcome"), F.lit("{}").alias("metadata"),
    )
    told = J.json_object({"originalLedgerEntryId": J.json_string(name(F.col("event_id") - 1))})
    replays = events.filter("event_type = 'click'").select(
        name(F.col("event_id")).alias("id"), F.lit("replay.passed").alias("entry_type"),
        F.lit("replay-success").alias("outcome"), told.alias("metadata"),
    )
    return replay.replays_with_originals(answered_rows.unionByName(replays))


@query
def result_summary(spark, d):
    """What a client sees of each question, with the id of its ledger row."""
    outcomes, _, _ = answered(spark, d)
    entries = questions(spark, d).select(
        F.col("query_id").alias("append_order"), F.sha2(F.col("query_id").cast("string"), 256).alias("id")
    )
    return answering.result_summary(outcomes, entries, "session").select(
        "outcome", "answer", "query_id", "corpus_snapshot_id", "corpus_snapshot_hash", "answer_hash",
        F.size("claims").alias("n_claims"), "ledger_entry_id",
    )


def verbatim_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a question word for word, found by its first line.

    Lines are joined by hash; only documents sharing the line are searched for the whole text. The few
    lines asked and the documents found are broadcast, so no text of the others is moved.
    """
    asked = questions(spark, d).withColumn("line", F.split("query_text", "\n")[0])
    lines = documents(spark, d).select(
        "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")
    )
    few = fits_broadcast(asked, retrieval.REFERENCE_BROADCAST_ROWS)
    hits = lines.join(F.broadcast(asked) if few else asked, "line").select("doc_id", "query_id", "query_text")
    hits = cut_lineage(hits)
    few = fits_broadcast(hits, retrieval.REFERENCE_BROADCAST_ROWS)
    found = documents(spark, d).join(F.broadcast(hits) if few else hits, "doc_id")
    return found.filter(F.contains("text", "query_text")).select(
        "query_id", F.concat_ws("/", "source", "doc_id").alias("source_path")
    )


@query
def gate_separation(spark, d):
    """Questions found as a line of some document against the rest, by best scores."""
    listed = verbatim_sources(spark, d).select("query_id").distinct().withColumn("_in", F.lit(True))
    probes = questions(spark, d).join(listed, "query_id", "left").select(
        "query_id",
        F.when(F.col("_in"), F.lit("in-corpus")).otherwise(F.lit("out-of-corpus")).alias("class"),
    )
    chunks = corpus(spark, d)
    given = lexical.scoring_input(chunks, questions(spark, d))
    sums = lexical.evidence_sums(given).withColumnRenamed("query_id", "probe_id")
    n_chunks = given.postings.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = evaluation.summed_distribution(sums, probes.withColumnRenamed("query_id", "probe_id"), n_chunks)
    return evaluation.gate_separation(stats)


def golden_verdicts(spark: SparkSession, d: str) -> DataFrame:
    outcomes, _, _ = answered(spark, d)
    sources = verbatim_sources(spark, d).select("query_id").distinct().withColumn("_in", F.lit(True))
    n = F.size(T.terms(F.col("query_text")))
    cases = questions(spark, d).join(sources, "query_id", "left").select(
        F.col("query_id").alias("id"),
        F.when(F.col("_in"), F.lit("answered")).otherwise(F.lit("refused-out-of-corpus")).alias(
            "expected_outcome"
        ),
        F.lit(None).cast("array<string>").alias("expected_chunks"),
        F.array(
            F.when(n > 30, F.lit("long")).otherwise(F.lit("short")),
            F.when(F.col("_in"), F.lit("verbatim")).otherwise(F.lit("other")),
        ).alias("tags"),
    )
    return evaluation.score_cases(cases, outcomes.withColumnRenamed("query_id", "id"))


@query
def case_verdicts(spark, d):
    """Cases with uncited claims, expected chunks that are not cited, and missing outcomes. Claims are
    the first lines of a document; a line cites its language, and its source if its length is odd."""
    docs = documents(spark, d)
    lines = F.slice(F.split("text", "\n"), 1, 3)
    claims = F.transform(
        lines,
        lambda x: F.struct(
            F.when(F.length(x) % 9 == 0, F.array().cast("array<string>"))
            .when(F.length(x) % 2 == 1, F.array(F.col("lang"), F.col("source")))
            .otherwise(F.array(F.col("lang")))
            .alias("cited")
        ),
    )
    kind = F.col("doc_id") % 4
    outcomes = docs.filter(F.col("doc_id") % 10 != 3).select(
        F.col("doc_id").alias("id"), claims.alias("claims"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("refused-out-of-corpus")).otherwise(F.lit("answered")).alias("outcome"),
    )
    cases = docs.select(
        F.col("doc_id").alias("id"), F.lit("answered").alias("expected_outcome"),
        F.when(kind == 0, F.array(F.col("lang"), F.col("source"))).when(kind == 1, F.array(F.col("lang")))
        .when(kind == 2, F.array().cast("array<string>")).alias("expected_chunks"),
        F.array(F.col("lang")).alias("tags"),
    )
    return evaluation.score_cases(cases, outcomes).drop("tags")


@query
def golden_run(spark, d):
    """A golden file of the questions over the documents as a hand-chunked corpus, and its record."""
    folder = f"{checkpoint_directory(spark)}/golden-{uuid.uuid4().hex}"
    sources = verbatim_sources(spark, d).select("query_id").distinct().withColumn("_in", F.lit(True))
    refused = F.lit("refused-out-of-corpus")
    questions(spark, d).join(sources, "query_id", "left").select(
        F.format_string("q%05d", "query_id").alias("id"), F.col("query_text").alias("question"),
        F.when(F.col("_in"), F.lit("answered")).otherwise(refused).alias("expected_outcome"),
        F.when(F.col("query_id") % 5 == 0, F.array(F.lit("missing"))).alias("expected_chunks"),
        F.array(F.when(F.col("_in"), F.lit("verbatim")).otherwise(F.lit("other"))).alias("tags"),
    ).write.json(folder)
    cases = json_lines.read_golden(spark, folder)
    verdicts = evaluating.golden_verdicts(cases, corpus(spark, d), SNAPSHOT_ID, SNAPSHOT_HASH)
    return evaluating.run_record(verdicts, evaluating.pinned_tuple(SNAPSHOT_HASH)).select(
        "case_count", "status", "per_tag_breakdown", "pinned_tuple", "output_json",
        *[F.round(c, 6).alias(c) for c in evaluation.THRESHOLDS],
    )


@query
def evaluation_run(spark, d):
    run = evaluation.evaluation_run(golden_verdicts(spark, d))
    return run.select("case_count", "status",
                      *[F.round(c, 6).alias(c) for c in evaluation.THRESHOLDS])


@query
def evaluation_by_tag(spark, d):
    tags = evaluation.tag_breakdown(golden_verdicts(spark, d))
    return tags.select("tag", "case_count",
                       *[F.round(c, 6).alias(c) for c in evaluation.THRESHOLDS])


# ---- time-driven --------------------------------------------------------------------------------


@query
def attempt_limits(spark, d):
    return limits.attempt_windows(
        timed_events(spark, d), "event_type", order=("event_id",)
    ).select("event_id", "window_start_ms", "attempt", "allowed")


@query
def attempt_limits_per_user(spark, d):
    return limits.attempt_windows(
        timed_events(spark, d), "user_id", window_ms=12 * 60 * limits.MINUTE_MS, limit=2,
        order=("event_id",),
    ).select("event_id", "window_start_ms", "attempt", "allowed")


@query
def write_limits(spark, d):
    """Two writes per client and four per event type within twelve hours, over the whole log."""
    return limits.write_limits(
        timed_events(spark, d), "event_type", "user_id", window_ms=12 * 60 * limits.MINUTE_MS,
        per_client=2, per_scope=4, order=("event_id",),
    ).select("event_id", "allowed")


@query
def write_limits_one_scope(spark, d):
    """The served limits, 20 writes per client and 60 in all, for one process that serves every event;
    event types stand for clients, as every one of them writes more than that in twelve hours."""
    events = timed_events(spark, d).withColumn("scope", F.lit("all"))
    return limits.write_limits(
        events, "scope", "event_type", window_ms=12 * 60 * limits.MINUTE_MS, order=("event_id",)
    ).select("event_id", "allowed")


@query
def ledger_capacity(spark, d):
    return limits.within_capacity(
        timed_events(spark, d), "user_id", ["ts_ms", "event_id"], 40
    ).select("event_id", "row_in_scope")


@query
def session_validity(spark, d):
    events = timed_events(spark, d)
    return limits.session_validity(
        events.filter(F.col("event_type") == "signup"),
        events.filter(F.col("event_type") != "signup"),
        "user_id", idle_ms=8 * 60 * limits.MINUTE_MS, absolute_ms=24 * 60 * limits.MINUTE_MS,
    ).select("event_id", as_text("session_start_ms"), "authorized")


@query
def challenge_use(spark, d):
    events = timed_events(spark, d)
    return limits.challenge_consumption(
        events.filter(F.col("event_type") == "signup"),
        events.filter(F.col("event_type") == "click"),
        "user_id", ttl_ms=24 * 60 * limits.MINUTE_MS, order=("event_id",),
    ).select("event_id", as_text("issued_ms"), "accepted")
