"""Hybrid retrieval: two rankings, fusion, evidence bar, refusal gate — for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators import dense, fusion, lexical, served
from attestra.operators.chunking import (
    chunk_id,
    chunk_records,
    token_windows,
    token_windows_with_offsets,
)
from attestra.operators.embedding import hash_embedding
from attestra.operators.fusion import parse_top_k
from attestra.operators.topk import fits_broadcast
from attestra.functions import hashing
from attestra.session import cut_lineage, stored_once


REFERENCE_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Retrieval:
    """Candidates of both rankers, their fusion, the cited evidence and the gate.

    ``refused`` says which queries the gate stops (``query_id, out_of_corpus``) without the best
    score; it comes from the ranked candidates alone and costs no further pass.
    """

    candidates: DataFrame
    fused: DataFrame
    evidence: DataFrame
    gate: DataFrame
    refused: DataFrame


def active_chunks(chunks: DataFrame, snapshot_id: str) -> DataFrame:
    """Chunks of one snapshot only; a partitioned store prunes everything else."""
    return chunks.filter(F.col("corpus_snapshot_id") == snapshot_id)


def dense_candidates(scores: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranking by supplied similarity, negative scores included; a chunk without one counts as 0."""
    # Counted and searched for the lowest ids: the text is cut once for both.
    chunks = stored_once(chunks.select("chunk_id", "source_path"))
    rows = scores.select(
        "query_id",
        "chunk_id",
        "source_path",
        F.lit(lexical.DENSE).alias("method"),
        F.round("score", lexical.SCORE_DECIMALS).alias("score"),
    )
    # Negative scores can take places among the k lowest chunks, so as many more are offered. A
    # query with k other scores, or with a score for every chunk, needs none.
    below = F.col("score") < 0
    taken = rows.groupBy("query_id").agg(
        F.count(F.when(below, 1)).alias("below"), F.count(F.lit(1)).alias("n")
    )
    total = chunks.agg(F.count(F.lit(1)).alias("n")).scalar()
    short = (F.col("n") - F.col("below") < k) & (F.col("n") < total)
    most = taken.filter(short).agg(F.max("below")).first()[0] or 0
    lowest = lexical.lowest_chunks(chunks, k + most)
    return lexical.rank_with_fill(
        rows, lowest, queries, [lexical.DENSE], k, negative=rows.filter(below)
    )


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int | None = None,
    dense_scores: DataFrame | None = None,
    trace: bool = False,
    materialize: bool = False,
) -> Retrieval:
    """Rank, fuse and gate.

    ``chunks``: ``chunk_id, source_path, chunk_text``; ``queries``: ``query_id, query_text``.
    ``dense_scores`` (``query_id, chunk_id, source_path, score``) replaces the lexical stand-in of
    the dense ranking; it can reorder evidence but never opens the gate. ``trace`` keeps the full
    candidate lists, including zero-score rows; without it only pairs that can end in a citation
    are carried, with the same evidence and gate. ``materialize`` writes the ranked candidates (at
    most two lists of 50 per query) once for callers that read several of the results.
    """
    k = lexical.CANDIDATE_LIMIT
    parse_top_k(top_k)
    best = None
    if dense_scores is not None:
        given = lexical.scoring_input(chunks, queries)
        both = lexical.filled_candidates(given, lexical.lowest_chunks(given.postings, k), queries, k)
        ranked = both.filter(F.col("method") == lexical.BM25).unionByName(
            dense_candidates(dense_scores, given.postings, queries, k)
        )
    elif trace:
        ranked = lexical.lexical_candidates(chunks, queries, k)
    else:
        lists = lexical.citable_lists(chunks, queries, k)
        if materialize:
            lists = cut_lineage(lists)
        ranked = lexical.merged_lists(lists, k)
        # The best score may belong to a chunk that is too weak to be carried.
        best = lexical.best_evidence(lists)
    if materialize:
        ranked = cut_lineage(ranked)
    fused = fusion.reciprocal_rank_fusion(ranked)
    carried = fusion.refusal_gate(queries, fusion.best_candidate(ranked))
    return Retrieval(
        ranked,
        fused,
        fusion.cited_evidence(fused, top_k),
        carried if best is None else fusion.refusal_gate(queries, best),
        carried.drop("best_evidence"),
    )


def hash_dense_scores(
    chunks: DataFrame, queries: DataFrame, dimension: int, k: int = lexical.CANDIDATE_LIMIT
) -> DataFrame:
    """Best ``k`` chunks per query by cosine of hash embeddings."""
    vectors = chunks.select(
        F.col("chunk_id").alias("id"),
        hash_embedding(F.col("chunk_text"), dimension).alias("vector"),
    )
    asked = queries.select(
        "query_id", hash_embedding(F.col("query_text"), dimension).alias("vector")
    )
    # Several branches read these few rows; the corpus is embedded once.
    found = cut_lineage(dense.cosine_top_k(vectors, asked, k, strict=False))
    return found.withColumnRenamed("id", "chunk_id")


def retrieve_served(
    chunks: DataFrame,
    queries: DataFrame,
    dimension: int,
    top_k: int | None = None,
) -> Retrieval:
    """Stored-vector path: cosine and all-terms ranks, fused; a refused query keeps no evidence."""
    k = parse_top_k(top_k)
    ranked_dense = hash_dense_scores(chunks, queries, dimension).select(
        "query_id", F.lit(lexical.DENSE).alias("method"), "rank", "chunk_id", "score"
    )
    ranked_terms = served.all_terms_candidates(chunks, queries).select(
        "query_id", "method", "rank", "chunk_id", "score"
    )
    ranked = fusion.finite_candidates(ranked_dense.unionByName(ranked_terms)).withColumn(
        "source_path", F.lit(None).cast("string")
    )
    fused = fusion.reciprocal_rank_fusion(ranked).drop("source_path")
    gate = fusion.served_gate(queries, ranked)
    kept = fused.join(gate.filter(~F.col("out_of_corpus")), "query_id", "left_semi").filter(
        F.col("rank") <= k
    )
    return Retrieval(ranked.drop("source_path"), fused, kept, gate, gate.drop("best_evidence"))


def _small(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and their documents, broadcast where few enough, so text is never shuffled."""
    wanted = references.select("source_path").distinct()
    if fits_broadcast(references, REFERENCE_BROADCAST_ROWS):
        return F.broadcast(references), F.broadcast(wanted)
    return references, wanted


def fetch_chunk_text(
    revisions: DataFrame, references: DataFrame, snapshot_id: str
) -> DataFrame:
    """Attach chunk text to ranked references (``chunk_id, source_path, ...``).

    References hold at most ``top_k`` rows per query, so only their documents are cut again; the
    rest of the corpus is dropped before chunking.
    """
    references, wanted = _small(references)
    documents = revisions.select("source_path", "text").join(wanted, "source_path", "left_semi")
    texts = (
        token_windows(documents)
        .withColumn("chunk_sha256", hashing.sha256_hex(F.col("chunk_text")))
        .select(
            chunk_id(F.lit(snapshot_id)).alias("chunk_id"),
            "chunk_text",
            F.lit(snapshot_id).alias("corpus_snapshot_id"),
        )
    )
    return texts.join(references, "chunk_id")


def fetch_chunk_records(
    revisions: DataFrame, references: DataFrame, snapshot_id: str, snapshot_hash: str
) -> DataFrame:
    """Attach full chunk records to ranked references, cutting only their documents again."""
    references, wanted = _small(references)
    documents = revisions.join(wanted, "source_path", "left_semi")
    records = chunk_records(
        token_windows_with_offsets(documents), F.lit(snapshot_id), F.lit(snapshot_hash)
    )
    return records.join(references.drop("source_path"), "chunk_id")


def evidence_bars(evidence: DataFrame) -> DataFrame:
    """Display bucket per cited chunk relative to the best one of its query: 10 to 100."""
    best = evidence.groupBy("query_id").agg(F.max("score").alias("_best"))
    ratio = F.when(F.col("_best") <= 0, F.lit(0.0)).otherwise(F.col("score") / F.col("_best"))
    bucket = F.least(F.lit(100), F.greatest(F.lit(10), F.ceil(ratio * 10).cast("int") * 10))
    return evidence.join(best, "query_id").withColumn("bar", bucket.cast("int")).drop("_best")


SPAN_BIN = 4096


def find_source_chunks(chunks: DataFrame, requests: DataFrame, span_bin: int = SPAN_BIN) -> DataFrame:
    """``requests`` (``doc_id, offset`` and more) with the first chunk of the document, by index, that
    starts at or after the offset; null where none does.

    A chunk answers the offsets above all starts before it, up to its own start. These stretches do
    not overlap; they are cut into bins of ``span_bin`` characters, so the lookup is an equality join
    on document and bin however many requests a document gets.
    """
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.select("doc_id", "chunk_index", "chunk_id", "char_start").withColumn(
        "_low", F.coalesce(F.max("char_start").over(before) + 1, F.lit(0))
    )
    bins = F.sequence(F.floor(F.col("_low") / span_bin), F.floor(F.col("char_start") / span_bin))
    stretches = placed.filter("char_start >= _low").select(
        F.col("doc_id").alias("_doc"), F.explode(bins).alias("_bin"), "_low", "char_start", "chunk_index", "chunk_id"
    )
    at = F.greatest(F.col("offset"), F.lit(0))
    asked = requests.withColumn("_at", at).withColumn("_ask", F.floor(F.col("_at") / span_bin))
    meets = (
        (F.col("doc_id") == F.col("_doc"))
        & (F.col("_ask") == F.col("_bin"))
        & F.col("_at").between(F.col("_low"), F.col("char_start"))
    )
    return asked.join(stretches, meets, "left").drop("_at", "_ask", "_doc", "_bin", "_low")


def find_source_chunk(chunks: DataFrame, doc_id: str, offset: int) -> DataFrame:
    """First chunk of a document that starts at or after an offset."""
    return (
        chunks.filter((F.col("doc_id") == doc_id) & (F.col("char_start") >= offset))
        .orderBy("doc_id", "chunk_index")
        .limit(1)
    )
