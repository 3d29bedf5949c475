"""How often the text of a corpus is read, and in what portions."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import chunking, evaluation, generation, ledger, lexical, served, snapshots
from attestra.operators.embedding import hash_embedding
from attestra.plans import retrieval
from attestra.session import BATCH_ROWS
from attestra.sources.snapshot_store import key_of
from tests.test_ledger import chained

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = ["alpha beta gamma alpha", "beta delta", "", "alpha-x gamma Beta beta", "delta 7 delta"]


@pytest.fixture
def given(spark):
    """Chunks whose text counts how often it is computed, questions and the counter."""
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    rows = [(f"chunk_{i:024x}", f"p/{i}", t) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_path string, chunk_text string")
    counted = chunks.withColumn("chunk_text", F.udf(count, "string")("chunk_text"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "delta")], "query_id int, query_text string")
    return chunks, counted, asked, read


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("rank", [lexical.lexical_candidates, served.all_terms_candidates])
def test_a_ranking_reads_the_text_once(given, rank):
    chunks, counted, asked, read = given
    columns = ["query_id", "method", "rank", "chunk_id", "source_path", "score"]
    assert rows(rank(counted, asked), *columns) == rows(rank(chunks, asked), *columns)
    assert read.value == len(TEXTS)


def test_supplied_scores_read_the_text_once_for_each_ranking(given):
    _, counted, asked, read = given
    scores = retrieval.hash_dense_scores(counted, asked, 8).withColumn("source_path", F.lit(None).cast("string"))
    assert read.value == len(TEXTS)
    retrieval.retrieve(counted, asked, dense_scores=scores).evidence.collect()
    assert read.value == 2 * len(TEXTS)


def test_embedding_takes_small_batches_and_empty_lists(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    try:
        texts = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, text string").coalesce(1)
        found = {r[0]: r[1] for r in texts.select("id", hash_embedding(F.col("text"), 8)).collect()}
        assert int(spark.conf.get(BATCH)) <= BATCH_ROWS
    finally:
        spark.conf.set(BATCH, before)
    assert found[2] == found[5] and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in found.values())
    one = spark.createDataFrame([(TEXTS[3],)], "text string").select(hash_embedding(F.col("text"), 8)).first()[0]
    assert one == found[3]


def test_places_equal_grouped_hits(given):
    chunks = given[0]
    key = key_of(F.col("chunk_id")).alias("key")
    hits = served.chunk_hits(chunks).select(key, F.inline("hits"))
    grouped = hits.groupBy("key", "term").agg(F.array_sort(F.collect_list("at")).alias("places"))
    columns = [F.hex("key"), "term", "places"]
    assert rows(served.chunk_places(chunks, key), *columns) == rows(grouped, *columns)


def test_known_counts_need_no_text(spark):
    documents = spark.createDataFrame([(1, "s", "a b c d e"), (2, "s", "second")], "doc_id int, source string, text string")
    revisions = chunking.revisions_from_documents(documents)
    want = snapshots.snapshot_row(revisions, 1, window=3, overlap=1).first()
    unread = revisions.withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    assert snapshots.snapshot_row(unread, 1, window=3, overlap=1, counted=(2, 3)).first() == want


def test_offsets_among_wide_blanks_and_astral_characters(spark):
    text = "eins  zwei \U0001f600﻿ drei\nvier 　fünf sechs"
    documents = spark.createDataFrame([(1, "s", text)], "doc_id int, source string, text string")
    found = chunking.token_windows_with_offsets(chunking.revisions_from_documents(documents), 2, 0)
    units = text.encode("utf-16-le")
    cut = [units[2 * r["char_start"] : 2 * r["char_end"]].decode("utf-16-le")
           for r in found.orderBy("chunk_index").collect()]
    assert cut == ["eins  zwei", "\U0001f600﻿ drei", "vier 　fünf", "sechs"]


def test_verification_orders_no_texts_and_chains_small_batches(spark, monkeypatch):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    try:
        entries = chained(spark)
        assert int(spark.conf.get(BATCH)) <= BATCH_ROWS
    finally:
        spark.conf.set(BATCH, before)
    ordered, previous = [], ledger.with_previous_id

    def seen(frame, *rest):
        ordered.append(set(frame.columns))
        return previous(frame, *rest)

    monkeypatch.setattr(ledger, "with_previous_id", seen)
    verdicts = ledger.verify_entries(entries).select("ok", "checked_rows").collect()
    assert [tuple(r) for r in verdicts] == [(True, 6), (True, 6)]
    assert not ordered[0] & {"canonical_payload", "query_text", "generated_answer", "metadata"}


def test_stored_postings_list_the_chunks_of_a_batch_and_equal_the_single_rows(spark):
    texts = ["Über Straße ueber x a-b a-b", "", "strasse Strasse über é x", "x 𝒳 ß", " . "]
    chunks = spark.createDataFrame(
        [("chunk_" + f"{i:024x}", "p", t) for i, t in enumerate(texts)], "chunk_id string, source_path string, chunk_text string"
    ).coalesce(1)
    postings = served.chunk_postings(chunks, key_of(F.col("chunk_id"))).cache()
    assert postings.count() == postings.select("word").distinct().count()
    places = served.unpacked(postings.select(F.col("word").alias("term"), "chunks", "places"))
    columns = ("key", "term", "places")
    assert rows(places, *columns) == rows(served.chunk_places(chunks, key_of(F.col("chunk_id")).alias("key")), *columns)
    terms = lexical.chunk_terms(chunks).select(
        key_of(F.col("chunk_id")).alias("key"), F.explode("terms").alias("term"), "n_terms"
    )
    single = served.unpacked(postings).filter("n_terms > 0")
    assert rows(single, "key", "term", "n_terms") == rows(terms, "key", "term", "n_terms")
    copies = served.unpacked(served.chunk_postings(chunks.unionAll(chunks).coalesce(1), key_of(F.col("chunk_id"))))
    both = rows(copies.filter("n_terms > 0"), "key", "term", "n_terms")
    assert both == sorted(2 * rows(terms, "key", "term", "n_terms"))
    counted = postings.groupBy("term").agg(F.sum("n_term").alias("df")).filter("df > 0")
    expected = terms.groupBy("term").agg(F.count("*").alias("df"))
    assert rows(counted, "term", "df") == rows(expected, "term", "df")


def test_revisions_that_carry_their_token_count_are_not_cut_to_count_windows(spark):
    revisions = spark.createDataFrame([("a b c",), ("",), ("  x\ty ",)], "text string")
    counted = revisions.withColumn(snapshots.TOKENS, snapshots.token_count(F.col("text")))
    assert [r[0] for r in counted.select(snapshots.TOKENS).collect()] == [3, 0, 2]
    plan = counted.select(snapshots.TOKENS).select(snapshots.revision_windows(counted, 2, 1).alias("n"))
    assert [r["n"] for r in plan.collect()] == [2, 0, 1]


def test_a_first_attempt_is_made_once_however_many_passes_read_it(spark):
    asked = spark.sparkContext.accumulator(0)

    def say(feedback):
        asked.add(1)
        return "CLAIM: x" if feedback is None else "CLAIM: y [chunk:c]"

    told = F.udf(say, "string")("feedback")
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "query_id int, prompt string")
    evidence = spark.createDataFrame([(1, "c", "s")], "query_id int, chunk_id string, corpus_snapshot_id string")
    final = generation.attempts(
        prompts, lambda p: p.select("query_id", told.alias("answer")), evidence, F.lit("s"), deterministic=False
    )
    errors = {r["query_id"]: len(r["errors"]) for r in final.collect()}
    assert errors == {1: 0, 2: 1, 3: 1}
    assert asked.value == 3 + 3


def test_evidence_sums_equal_those_over_pairs(spark, given, monkeypatch):
    chunks, _, asked, _ = given
    asked = asked.unionByName(spark.createDataFrame([(3, "nowhere"), (4, "x gamma x")], asked.schema))
    scoring = lexical.scoring_input(chunks.repartition(3), asked)
    pairs = lexical.score_pairs(scoring).select(F.col("query_id").alias("probe_id"), F.col("evidence").alias("score"))
    probes = asked.select(F.col("query_id").alias("probe_id"), F.lit("in-corpus").alias("class"))
    want = evaluation.score_distribution(pairs, probes, F.lit(len(TEXTS)))
    monkeypatch.setattr(lexical, "score_pairs", None)
    sums = lexical.evidence_sums(scoring).withColumnRenamed("query_id", "probe_id")
    got = evaluation.summed_distribution(sums, probes, F.lit(len(TEXTS)))
    columns = ["probe_id", "class", *[F.round(c, 9) for c in ("best", "mean", "deviation", "second")]]
    assert rows(got, *columns) == rows(want, *columns)


def test_a_ranking_folds_each_word_of_a_batch_once(spark):
    texts = ["Über ueber x Straße über", "", "a-b 7 𝒳 strasse", " . "]
    chunks = spark.createDataFrame([(f"c{i}", "p", t) for i, t in enumerate(texts)], "chunk_id string, source_path string, chunk_text string")
    every = lexical.chunk_terms(chunks).select("chunk_id", "source_path", "terms", "n_terms")
    asked = sorted({t for r in every.collect() for t in r["terms"]})
    columns = ["chunk_id", "source_path", "terms", "n_terms"]
    assert rows(lexical.asked_terms(chunks, asked), *columns) == rows(every, *columns)
    few = {r["chunk_id"]: (r["terms"], r["n_terms"]) for r in lexical.asked_terms(chunks, ["strasse"]).collect()}
    assert few == {"c0": (["strasse"], 2), "c1": ([], 0), "c2": (["strasse"], 3), "c3": ([], 0)}
