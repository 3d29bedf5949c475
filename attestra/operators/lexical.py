"""IDF-weighted coverage ranking over postings.

Shape of the plan for ranked lists:

1. tokenise every chunk once and keep only terms some query asks for (map side);
2. one exchange by ``chunk_id`` carrying those short arrays, never the text, stored behind it;
3. the document-frequency pass, the scoring pass and the lowest ids read what was stored;
4. scoring adds up the weights of a block of queries in Arrow batches (``lexical_scan``); no row is
   made for a pair of query and chunk, and every task keeps its own best candidates;
5. one small exchange by query merges the tasks' lists.

``score_pairs`` gives every pair that shares a term, for statistics over all of them: it joins the
query weights, broadcast or salted by term, and aggregates by (chunk, query).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators.lexical_scan import BEST, scan_lists, scan_sums
from attestra.operators.topk import default_fanout, top_k
from attestra.session import small_batches, stored_once

# Fixed values of the ranking formula.
CANDIDATE_LIMIT = 50
EVIDENCE_THRESHOLD = 0.3
MAX_DENSITY = 0.2
MIN_LENGTH = 10
SCORE_DECIMALS = 6

BROADCAST_TERM_ROWS = 500_000
TERM_SALTS = 32
VOCABULARY_BUCKETS = 4096
# Stands for "every chunk" in the frequency table; no term is shorter than two characters.
ALL_CHUNKS = ""

DENSE, BM25 = "dense", "bm25"


def inverse_document_frequency(total: Column, frequency: Column) -> Column:
    return F.log(F.lit(1.0) + (total - frequency + F.lit(0.5)) / (frequency + F.lit(0.5)))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query plus the ``ALL_CHUNKS`` marker (``query_id, query_text`` in)."""
    return queries.select(
        "query_id",
        F.explode(
            F.concat(F.array(F.lit(ALL_CHUNKS)), F.array_distinct(T.terms(F.col("query_text"))))
        ).alias("term"),
    )


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """Distinct terms of each chunk and their number."""
    return chunks.select(
        "chunk_id",
        "source_path",
        F.array_distinct(T.terms(F.col("chunk_text"))).alias("terms"),
    ).withColumn("n_terms", F.size("terms"))


def folded_terms(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Folds of lower-cased words, and which of them are terms; ``text.terms`` of words."""
    for umlaut, folded in T.UMLAUT_FOLDS:
        words = pc.replace_substring(words, umlaut, folded)
    is_term = pc.or_(pc.greater(pc.utf8_length(words), 1), pc.greater(pc.binary_length(words), 3))
    return words, is_term.to_numpy(zero_copy_only=False)


def asked_terms(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``chunk_terms`` with only the terms of a vocabulary; ``n_terms`` counts all of them.

    Text is split natively. A batch's distinct words are folded and looked up once each, whatever the
    number of chunks that hold them; splitting and folding can be exchanged.
    """
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            folded, is_term = folded_terms(coded.dictionary)
            folded = folded.dictionary_encode()
            code = folded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            word = coded.indices.to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(lengths)), lengths)[is_term[word]]
            term = code[word[is_term[word]]]
            # Each term of a chunk once, where it first stands.
            first = np.sort(np.unique(own * (len(folded.dictionary) + 1) + term, return_index=True)[1])
            own, term = own[first], term[first]
            asked = pc.is_in(folded.dictionary, value_set=known).to_numpy(zero_copy_only=False)[term]
            offsets = np.append(0, np.cumsum(np.bincount(own[asked], minlength=len(lengths)))).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(offsets), folded.dictionary.take(pa.array(term[asked])))
            n_terms = pa.array(np.bincount(own, minlength=len(lengths)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("source_path"), terms, n_terms],
                ["chunk_id", "source_path", "terms", "n_terms"],
            )

    small_batches(chunks.sparkSession)
    words = F.split(F.lower(F.col("chunk_text")), T.TERM_SEPARATOR).alias("words")
    return chunks.select("chunk_id", "source_path", words).mapInArrow(
        run, "chunk_id string, source_path string, terms array<string>, n_terms int"
    )


def _marked(terms: str = "terms") -> Column:
    # Exploding a bare column would make the optimizer test its size first and tokenise twice.
    return F.concat(F.array(F.lit(ALL_CHUNKS)), F.col(terms))


def document_frequencies(chunk_term_arrays: DataFrame) -> DataFrame:
    """Chunks per term, plus one ``ALL_CHUNKS`` row with the number of chunks.

    Counts are combined on the map side, so a term found in every chunk costs one row per task.
    """
    return (
        chunk_term_arrays.select(F.explode(_marked()).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def corpus_term_weights(chunks: DataFrame) -> DataFrame:
    """IDF of every term of the corpus: ``term, df, n_chunks, idf``."""
    frequencies = document_frequencies(chunk_terms(chunks))
    total = chunks.select(F.count(F.lit(1)).alias("n")).scalar()
    return frequencies.filter(F.col("term") != ALL_CHUNKS).select(
        "term",
        "df",
        total.alias("n_chunks"),
        F.round(inverse_document_frequency(total, F.col("df")), SCORE_DECIMALS).alias("idf"),
    )


def query_weights(wanted: DataFrame, frequencies: DataFrame) -> DataFrame:
    """IDF of each query term and the query's total, unmatched terms included."""
    per_query = Window.partitionBy("query_id")
    marker = F.col("term") == ALL_CHUNKS
    return (
        wanted.join(frequencies, "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("_n", F.max(F.when(marker, F.col("df"))).over(per_query))
        .withColumn("weight", inverse_document_frequency(F.col("_n"), F.col("df")))
        .withColumn("query_weight", F.sum(F.when(~marker, F.col("weight"))).over(per_query))
        .filter(~marker)
        .select("query_id", "term", "weight", "query_weight")
    )


def _postings(arrays: DataFrame, *columns: Column) -> DataFrame:
    """One row per (chunk, term); the marker row finds no partner in the weights."""
    return arrays.select(
        "chunk_id", "source_path", "n_terms", *columns, F.explode(_marked()).alias("term")
    )


def _scores(pairs: DataFrame) -> DataFrame:
    base = F.col("matched") / F.col("query_weight")
    density = F.least(
        F.lit(MAX_DENSITY),
        F.col("matched") / F.greatest(F.lit(MIN_LENGTH), F.col("n_terms")),
    )
    return pairs.select(
        "query_id",
        "chunk_id",
        "source_path",
        F.round(F.least(F.lit(1.0), base), SCORE_DECIMALS).alias("coverage"),
        F.round(F.least(F.lit(1.0), base + base * density), SCORE_DECIMALS).alias("evidence"),
    )


def bucketed_vocabulary(wanted: DataFrame, buckets: int = VOCABULARY_BUCKETS) -> Column:
    """The asked terms as an array of small arrays, addressed by the hash of the term."""
    slots = wanted.sparkSession.range(buckets).withColumnRenamed("id", "slot")
    slot = F.pmod(F.xxhash64("term"), F.lit(buckets))
    filled = slots.join(wanted.select(slot.alias("slot"), "term"), "slot", "left")
    lists = filled.groupBy("slot").agg(F.collect_set("term").alias("ts"))
    return lists.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slot", "ts"))), lambda x: x["ts"]
        ).alias("v")
    ).scalar()


def restrict_terms(
    frame: DataFrame,
    column: str,
    wanted: DataFrame,
    buckets: int = VOCABULARY_BUCKETS,
    term: Callable[[Column], Column] = lambda item: item,
) -> DataFrame:
    """Keep only items of an array column whose ``term`` is asked; each term is compared with its
    own slot alone."""

    def asked(t: Column) -> Column:
        slot = F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")
        return F.array_contains(F.get(F.col("_vocabulary"), slot), t)

    kept = F.filter(column, lambda item: asked(term(item)))
    # The optimizer folds the helper column into the filter, so it is never stored with a row.
    return (
        frame.withColumn("_vocabulary", bucketed_vocabulary(wanted, buckets))
        .withColumn(column, kept)
        .drop("_vocabulary")
    )


@dataclass(frozen=True)
class ScoringInput:
    """Postings grouped by chunk, query weights, and whether the weights fit a broadcast."""

    postings: DataFrame
    weights: DataFrame
    small: bool


def scoring_input(
    chunks: DataFrame, queries: DataFrame, broadcast_rows: int = BROADCAST_TERM_ROWS
) -> ScoringInput:
    wanted = query_terms(queries)
    listed = wanted.select("term").limit(broadcast_rows + 1).collect()
    small = len(listed) <= broadcast_rows
    arrays = asked_terms(chunks, sorted({r["term"] for r in listed})) if small else chunk_terms(chunks)
    # Weights, scores and lowest ids are jobs of their own; the text is cut into terms once.
    postings = stored_once(arrays.repartition("chunk_id"))
    return ScoringInput(postings, query_weights(wanted, document_frequencies(postings)), small)


def score_pairs(given: ScoringInput) -> DataFrame:
    """Scores of every (query, chunk) pair sharing a term.

    ``coverage`` is the share of the query's information the chunk carries; ``evidence`` adds the
    bounded length preference.
    """
    keys = ["chunk_id", "source_path", "n_terms", "query_id", "query_weight"]
    if given.small:
        matches = _postings(given.postings).join(F.broadcast(given.weights), "term")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))).alias("salt")
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_SALTS)).cast("int").alias("salt")
        matches = _postings(given.postings, salt).join(
            given.weights.select("*", salts), ["term", "salt"]
        )
    return _scores(matches.groupBy(*keys).agg(F.sum("weight").alias("matched")))


def candidate_order(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("chunk_id").asc()]


def ranked_lists(given: ScoringInput, k: int, bound: float = 0.0) -> DataFrame:
    """Each task's best of both rankings, and its best evidence per query as method ``BEST``."""
    formula = (MAX_DENSITY, MIN_LENGTH, SCORE_DECIMALS)
    return scan_lists(given.postings, given.weights, k, (DENSE, BM25), formula, bound)


def evidence_sums(given: ScoringInput) -> DataFrame:
    """Per query over the chunks that share a term: best and second evidence, number, sum and sum of
    squares, added up by the tasks, so no pair is grouped."""
    parts = scan_sums(given.postings, given.weights, (MAX_DENSITY, MIN_LENGTH, SCORE_DECIMALS))
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.array("best", "second"))), asc=False), 1, 2)
    # A task with one score has no second one.
    known = F.filter(top, lambda x: x.isNotNull())
    return parts.groupBy("query_id").agg(
        F.get(known, F.lit(0)).alias("_best"),
        F.sum("scored").alias("_scored"),
        F.sum("sum").alias("_sum"),
        F.sum("squares").alias("_squares"),
        F.get(known, F.lit(1)).alias("_second"),
    )


def lowest_chunks(chunks: DataFrame, k: int) -> Column:
    """The ``k`` lowest chunk ids with their paths, as one array."""
    ordered = chunks.select(F.struct("chunk_id", "source_path").alias("c")).orderBy("c.chunk_id")
    return ordered.limit(k).select(F.collect_list("c").alias("v")).scalar()


def rank_with_fill(
    scored: DataFrame,
    lowest: Column,
    queries: DataFrame,
    methods: list[str],
    k: int,
    negative: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` per (query, method), completed with zero-score chunks where fewer match.

    Every active chunk is ranked, so short lists end in zero rows; a chunk with a score of its own
    is never filled in. ``lowest`` holds the lowest chunk ids of the corpus: any zero row that makes
    a list of ``k`` is among them as long as a list has no more negative scores than ``lowest`` has
    ids beyond ``k``. ``negative`` holds the rows of ``scored`` below zero, if there can be any.
    """
    columns = ["query_id", "method", "chunk_id", "source_path", "score"]
    matched = top_k(
        scored, ["query_id", "method"], candidate_order(), k, fanout=default_fanout(scored)
    ).select(*columns)
    fillers = queries.select(
        "query_id",
        F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"),
        lowest.alias("_fillers"),
    ).select("query_id", "method", F.inline("_fillers"), F.lit(0.0).alias("score"))
    # Chunks with a positive score outrank their own filler; only those with a negative one, which
    # may have been cut from the list, have to be looked up.
    free = fillers.select(*columns)
    if negative is not None:
        keys = ["query_id", "method", "chunk_id"]
        free = free.join(negative.select(*keys), keys, "left_anti")
    best = matched.withColumn("_given", F.lit(1)).unionByName(free.withColumn("_given", F.lit(0)))
    once = best.groupBy("query_id", "method", "chunk_id", "source_path").agg(
        F.max(F.struct("_given", "score")).alias("_best")
    )
    distinct = once.select(
        "query_id", "method", "chunk_id", "source_path", F.col("_best.score").alias("score")
    )
    return top_k(distinct, ["query_id", "method"], candidate_order(), k)


def lexical_candidates(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_LIMIT,
    broadcast_rows: int = BROADCAST_TERM_ROWS,
) -> DataFrame:
    """Both lexical rankings: ``query_id, method, rank, chunk_id, source_path, score``."""
    given = scoring_input(chunks, queries, broadcast_rows)
    return filled_candidates(given, lowest_chunks(given.postings, k), queries, k)


def filled_candidates(given: ScoringInput, lowest: Column, queries: DataFrame, k: int) -> DataFrame:
    """Both rankings of every chunk; ``lowest``: as in ``rank_with_fill``."""
    lists = ranked_lists(given, k).filter(F.col("method") != BEST)
    return rank_with_fill(lists, lowest, queries, [DENSE, BM25], k)


@dataclass(frozen=True)
class EvidenceBound:
    """Smallest coverage a citable chunk can have: evidence is at most coverage * (1 + density)."""

    threshold: float = EVIDENCE_THRESHOLD

    @property
    def coverage(self) -> float:
        # The slack absorbs rounding of either score to six decimals.
        return self.threshold / (1.0 + MAX_DENSITY) - 2e-6


def citable_lists(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_LIMIT,
    broadcast_rows: int = BROADCAST_TERM_ROWS,
) -> DataFrame:
    """``ranked_lists`` cut to chunks that can still lead to a citation.

    Only chunks whose evidence clears the bar are ever cited, and everything ranked above such a
    chunk also clears the coverage bound. So ranks of citable chunks equal those of the full lists,
    while chunks that share only common words are dropped before any sort.
    """
    return citable_of(scoring_input(chunks, queries, broadcast_rows), k)


def citable_of(given: ScoringInput, k: int = CANDIDATE_LIMIT) -> DataFrame:
    return ranked_lists(given, k, EvidenceBound().coverage)


def merged_lists(lists: DataFrame, k: int = CANDIDATE_LIMIT) -> DataFrame:
    """Both rankings of all tasks' lists."""
    return top_k(
        lists.filter(F.col("method") != BEST),
        ["query_id", "method"], candidate_order(), k, fanout=default_fanout(lists),
    )


def best_evidence(lists: DataFrame) -> DataFrame:
    """``query_id, best`` over all chunks, carried or not."""
    return (
        lists.filter(F.col("method") == BEST).groupBy("query_id").agg(F.max("score").alias("best"))
    )


def evidence_candidates(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_LIMIT,
    broadcast_rows: int = BROADCAST_TERM_ROWS,
) -> DataFrame:
    """Both rankings of the chunks that can be cited."""
    return merged_lists(citable_lists(chunks, queries, k, broadcast_rows), k)
