import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import canonical_json as J
from attestra.operators import report
from attestra.plans import evaluating, providers, reporting
from attestra.sources.ledger_store import LedgerStore
from tests.test_ledger import inputs


def evaluation(spark):
    return spark.createDataFrame([(1.0, 0.8, 1.0)],
                                 "groundedness double, citation_accuracy double, refusal_correctness double")


def test_report_is_deterministic_and_recorded(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), bytes(range(32)))
    store.append(inputs(spark, 9, 1), ["n"])
    since, until = report.iso_from_ms(1000), report.iso_from_ms(1007)
    run = lambda n: reporting.generate_report(
        store, "l0", evaluation(spark), since, until, str(tmp_path / n), "Test [System]")
    first, second = run("a"), run("b")
    assert first["jsonSha256"] == second["jsonSha256"] and first["bundleSha256"] == second["bundleSha256"]
    text = spark.read.text(str(tmp_path / "a" / "disclosure")).first()[0]
    body = json.loads(text)
    assert J.canonical_text(body) == text
    assert body["queryVolume"] == 5 and body["outcomeBreakdown"] == {"answered": 5}
    assert body["evalScores"] == {"groundedness": 1, "citationAccuracy": 0.8, "refusalCorrectness": 1}
    markup = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "a" / "markup")).collect())
    assert markup.startswith("= Test \\[System\\] EU AI Act") and "- This Article 50" in markup
    assert "== Query volume\n- 5\n" in markup and "- Citation accuracy: 0.8\n" in markup
    assert "== Model versions\n- none\n" in markup and "== Outcome breakdown\n- answered: 5\n" in markup
    events = store.entries().filter(F.col("entry_type") == "report.generated").filter("n IS NULL")
    assert events.count() == 2 and {r["timestamp_ms"] for r in events.collect()} == {1007}
    assert store.verify().first()["ok"]


def test_golden_run_from_files(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "a.md").write_text(
        "<!-- chunk:art-50 -->\nAnbieter müssen natürliche Personen über die Interaktion mit KI-Systemen informieren.\n"
        "<!-- chunk:art-3 -->\nEin Betreiber verwendet ein System in eigener Verantwortung.\n")
    cases = [
        {"id": "one", "question": "Müssen Anbieter natürliche Personen über die Interaktion informieren?",
         "expected_outcome": "answered", "expected_chunks": ["art-50"], "tags": ["duty"]},
        {"id": "two", "question": "Welche Eigenkapitalquote gilt 2030?",
         "expected_outcome": "refused-out-of-corpus", "tags": ["out-of-corpus"]},
    ]
    golden = tmp_path / "golden.jsonl"
    golden.write_text("\n".join(json.dumps(c) for c in cases))
    run = evaluating.run_golden(spark, str(golden), str(corpus)).first()
    assert (run["status"], run["case_count"]) == ("passed", 2)
    body = json.loads(run["output_json"])
    assert J.canonical_text(body) == run["output_json"] and body["caseCount"] == 2
    assert sorted(body["perTagBreakdown"]) == ["duty", "out-of-corpus"]
    assert body["pinnedTuple"]["corpusHash"] and body["thresholds"]["refusal_correctness"] == 0.9
    cases[0]["expected_chunks"] = ["art-3", "art-50"]
    golden.write_text("\n".join(json.dumps(c) for c in cases))
    worse = evaluating.run_golden(spark, str(golden), str(corpus)).first()
    assert worse["status"] == "failed" and worse["citation_accuracy"] == 0.5
    assert worse["pinned_tuple"] == run["pinned_tuple"]
    golden.write_text("")
    with pytest.raises(ValueError, match="empty"):
        evaluating.run_golden(spark, str(golden), str(corpus))


def test_service_embedding(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, text string")
    got = providers.embed_with_service(texts, lambda ts: [[1.0, len(t)] for t in ts], 2).collect()
    assert {r["id"]: r["vector"] for r in got} == {i: [1.0, 2.0] for i in range(5)}
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="embedding"):
            providers.embed_with_service(texts, lambda ts, b=bad: [b for _ in ts], 2).collect()


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.TransientServiceError
        return "ok"

    assert providers.with_retries(flaky, sleep=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(ValueError):
        providers.with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)
    assert providers.backoff_delay_ms(10, 100, 400, lambda: 1.0) == 400
    assert [providers.is_transient_status(s) for s in (200, 404, 408, 429, 503)] == [
        False, False, True, True, True]


def test_service_provider(spark):
    prompts = spark.createDataFrame([(1, "p")], "query_id int, prompt string")
    assert providers.service_provider(lambda ps: [p + "!" for p in ps])(prompts).first()["answer"] == "p!"
