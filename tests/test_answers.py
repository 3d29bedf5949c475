import json

import pytest
from pyspark.sql import functions as F

from attestra.domain import EXTRACTIVE_PROFILE, MESSAGE_BLOCKED, ProviderProfile
from attestra.operators import evaluation, generation, ledger, replay
from attestra.plans import answering, retrieval
from attestra.session import cut_lineage
from attestra.operators.chunking import revisions_from_documents

DOCS = [
    (1, "law", "Anbieter müssen Personen informieren. Die Information erfolgt klar. Ausnahmen gelten."),
    (2, "law", "Synthetische Inhalte müssen gekennzeichnet werden! Das Format ist maschinenlesbar."),
    (3, "law", "Strafverfolgung ist ausgenommen. Biometrie bleibt verboten."),
]
QUERIES = [
    (1, "Müssen Anbieter Personen informieren?"),
    (2, "Müssen synthetische Inhalte gekennzeichnet werden?"),
    (3, "Welche Eigenkapitalquote verlangt Basel für Sparkassen?"),
]


def setup(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, source string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id int, query_text string")
    return revisions_from_documents(docs), queries


def run(spark, **options):
    revisions, queries = setup(spark)
    return answering.answer_queries(revisions, queries, "snap_1", "hash_1", **options)


def by_id(frame):
    return {r["query_id"]: r for r in frame.collect()}


def test_extractive_answers_lift_sentences(spark):
    outcomes, evidence, _ = run(spark)
    rows = by_id(outcomes)
    ids = {r["query_id"]: r["chunk_id"] for r in evidence.collect()}
    assert rows[1]["answer"] == f"CLAIM: Anbieter müssen Personen informieren. [chunk:{ids[1]}]"
    assert rows[2]["answer"].startswith("CLAIM: Synthetische Inhalte müssen gekennzeichnet werden!")
    assert rows[3]["outcome"] == "refused-out-of-corpus" and rows[3]["answer"] is None
    assert rows[1]["seed"] == 42 and rows[1]["claims"][0]["cited"] == [ids[1]]


def test_retry_then_block(spark):
    good_after = lambda: generation.fixed_provider(["no citation", "CLAIM: still none"])
    rows = by_id(run(spark, provider=good_after(), deterministic=False)[0])
    assert rows[1]["outcome"] == "blocked-uncited" and rows[1]["operator_message"] == MESSAGE_BLOCKED
    assert rows[1]["validation_errors"][0]["code"] == "missing_citation"
    assert rows[3]["outcome"] == "refused-out-of-corpus" and rows[3]["validation_errors"] == []
    _, evidence, _ = run(spark)
    cid = next(r["chunk_id"] for r in evidence.collect() if r["query_id"] == 1)
    second_ok = generation.fixed_provider(["bad", f"CLAIM: gut [chunk:{cid}]"])
    rows = by_id(run(spark, provider=second_ok, deterministic=False)[0])
    assert rows[1]["outcome"] == "answered" and rows[2]["outcome"] == "blocked-uncited"


def test_empty_answer_has_no_claims_and_passes(spark):
    rows = by_id(run(spark, provider=generation.fixed_provider([""]))[0])
    assert rows[1]["outcome"] == "answered" and rows[1]["answer"] == "" and rows[1]["claims"] == []


def test_claims_and_validation(spark):
    text = "CLAIM: Eins. [chunk:a] [chunk:b]\n\n  claim: zwei [chunk:x-1]\nohne Beleg\n   \n"
    answers = spark.createDataFrame([(1, text)], "query_id int, answer string")
    claims = generation.parse_claims(answers)
    rows = sorted(claims.collect(), key=lambda r: r["claim_index"])
    assert [(r["claim_text"], r["cited"]) for r in rows] == [
        ("Eins.", ["a", "b"]), ("zwei", ["x-1"]), ("ohne Beleg", [])]
    known = spark.createDataFrame([(1, "a", "s"), (1, "b", "other")],
                                  "query_id int, chunk_id string, corpus_snapshot_id string")
    errors = generation.validate_claims(claims, known, F.lit("s")).collect()
    assert sorted((e["claim_index"], e["code"], e["detail"]) for e in errors) == [
        (0, "wrong_snapshot", "b"), (1, "invalid_chunk", "x-1"),
        (2, "missing_citation", "claim has no citation")]
    marks = generation.citations(claims).collect()
    assert {m["marker"] for m in marks} == {"[chunk:a]", "[chunk:b]", "[chunk:x-1]"}


def test_prompt_without_evidence(spark):
    prompt = spark.createDataFrame([(1, "no layout"), (2, "x\nFrage:\nq?\n\nEvidenz:\n")],
                                   "query_id int, prompt string")
    got = {r["query_id"]: r["answer"] for r in generation.extractive_provider(prompt).collect()}
    assert set(got.values()) == {generation.NO_EVIDENCE_ANSWER}


def test_fallback_is_the_first_sentence(spark):
    prompt = "x\nFrage:\nunrelated words\n\nEvidenz:\n[chunk:a] Erster Satz. Zweiter.\n[chunk:b] Dritter."
    frame = spark.createDataFrame([(1, prompt)], "query_id int, prompt string")
    assert generation.extractive_provider(frame).first()["answer"] == (
        "CLAIM: Erster Satz. [chunk:a]")


def test_ledger_inputs_and_replay(spark):
    revisions, queries = setup(spark)
    outcomes, evidence, found = run(spark)
    outcomes = cut_lineage(outcomes)
    records = retrieval.fetch_chunk_records(
        revisions, found.evidence.select("query_id", "rank", "chunk_id", "source_path", "score"),
        "snap_1", "hash_1")
    inputs = answering.query_ledger_inputs(outcomes, records, "main", "u" * 64, "sess", 1234)
    entries = ledger.append_entries(inputs, ["append_order"]).withColumn("signature", F.lit("x"))
    entries = cut_lineage(entries)
    assert ledger.verify_entries(entries).first()["ok"]
    rows = {r["append_order"]: r for r in entries.collect()}
    chunk = json.loads(rows[1]["retrieved_chunks"])[0]
    assert chunk["retrievalMethod"] == "rrf" and chunk["corpusSnapshotId"] == "snap_1"
    assert rows[3]["entry_type"] == "query.refused_out_of_corpus" and rows[3]["retrieved_chunks"] == "[]"
    assert json.loads(rows[1]["claim_citations"])[0]["chunkId"] == chunk["chunkId"]
    summary = answering.result_summary(outcomes, entries, "sess")
    assert summary.filter("ledger_entry_id IS NULL").count() == 0

    status = lambda **kw: {
        r["append_order"]: (r["status"], r["byte_equal"], r["drift_artifact"])
        for r in replay.replay_entries(entries, **kw).collect()}
    assert status() == {1: ("passed", True, None), 2: ("passed", True, None),
                        3: ("error", None, "unknown")}
    moved = replay.ReplayArtifacts(prompt_hash=F.lit("p"), model_version=F.lit("m"))
    assert status(artifacts=moved)[1] == ("drift", False, "prompt")
    none = ProviderProfile("x", "x", "x", "unsupported", False)
    assert status(profile=none, artifacts=moved)[1] == ("unsupported", None, "prompt")
    other = status(provider=generation.echo_provider)
    assert other[1] == ("drift", False, "provider_infrastructure")
    new_rows = replay.replay_inputs(replay.replay_entries(entries))
    assert sorted(r["entry_type"] for r in new_rows.collect()) == ["replay.passed", "replay.passed"]


def test_wrong_seed_support_is_recorded(spark):
    cloud = ProviderProfile("cloud", "cloud", "c@1", "drift_detect_only", False)
    row = by_id(run(spark, profile=cloud)[0])[1]
    assert row["seed"] is None and row["seed_unsupported"] and row["provider_profile_id"] == "cloud"
    assert EXTRACTIVE_PROFILE.seed == 42


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [("a", "answered", ["x"], ["t1"]), ("b", "refused-out-of-corpus", None, ["t2"]),
         ("c", "answered", ["x", "y"], ["t1"]), ("missing", "answered", None, ["t3"])],
        "id string, expected_outcome string, expected_chunks array<string>, tags array<string>")
    claim = "array<struct<claim_index:int,claim_id:string,claim_text:string,cited:array<string>>>"
    outcomes = spark.createDataFrame(
        [("a", "answered", [(0, "i", "t", ["x", "z"])]), ("b", "refused-out-of-corpus", []),
         ("c", "answered", [(0, "i", "t", ["x"]), (1, "j", "t", [])])],
        f"id string, outcome string, claims {claim}")
    verdicts = evaluation.score_cases(cases, outcomes)
    got = {r["id"]: (r["grounded"], r["cited_expected"], r["refusal_correct"]) for r in verdicts.collect()}
    assert got == {"a": (True, True, True), "b": (True, True, True), "c": (False, False, True),
                   "missing": (False, False, False)}
    run_row = evaluation.evaluation_run(verdicts).first()
    assert run_row["status"] == "failed" and run_row["groundedness"] == 0.5
    assert run_row["refusal_correctness"] == 0.75
    tags = {r["tag"]: r["groundedness"] for r in evaluation.tag_breakdown(verdicts).collect()}
    assert tags == {"t1": 0.5, "t2": 1.0, "t3": 0.0}
    good = evaluation.evaluation_run(verdicts.filter("id in ('a', 'b')")).first()
    assert good["status"] == "passed"


def test_separation(spark):
    rows = [("i1", "in-corpus", s) for s in (0.9, 0.5, 0.1)] + [
        ("o1", "out-of-corpus", s) for s in (0.4, 0.4, 0.1)]
    scored = spark.createDataFrame(rows, "probe_id string, class string, score double")
    stats = evaluation.score_distribution(
        scored.select("probe_id", "score"), scored.select("probe_id", "class").distinct(), F.lit(3))
    got = {r["form"]: r["separation"] for r in evaluation.gate_separation(stats).collect()}
    assert got["best"] == 0.5 and got["mean"] == 0.2 and got["best_minus_second"] == 0.4


def test_separation_counts_chunks_without_a_score(spark):
    scores = spark.createDataFrame([("i", 0.8), ("o", 0.2), ("o", 0.1)], "probe_id string, score double")
    probes = spark.createDataFrame(
        [("i", "in-corpus"), ("o", "out-of-corpus"), ("none", "out-of-corpus")],
        "probe_id string, class string")
    got = {r["probe_id"]: r for r in evaluation.score_distribution(scores, probes, F.lit(4)).collect()}
    assert got["i"]["mean"] == pytest.approx(0.2) and got["i"]["second"] == 0.0
    assert got["o"]["second"] == 0.1 and got["o"]["mean"] == pytest.approx(0.075)
    assert got["i"]["deviation"] == pytest.approx((0.64 / 4 - 0.04) ** 0.5)
    assert got["none"]["best"] == got["none"]["mean"] == got["none"]["deviation"] == 0.0


def test_bars(spark):
    frame = spark.createDataFrame([(1, "a", 0.0333), (1, "b", 0.0166), (1, "c", 0.001), (2, "d", 0.0)],
                                  "query_id int, chunk_id string, score double")
    got = {r["chunk_id"]: r["bar"] for r in retrieval.evidence_bars(frame).collect()}
    assert got == {"a": 100, "b": 50, "c": 10, "d": 10}
