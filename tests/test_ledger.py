import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import canonical_json as J
from attestra.functions import ed25519
from attestra.operators import ledger, replay, report

GENESIS = "0" * 64


def inputs(spark, n=12, ledgers=2):
    rows = [
        (f"l{i % ledgers}", i, "query.answered" if i % 3 else "report.generated",
         "answered" if i % 3 else "report-generated", f'frage "{i}"\n\x0b' if i % 2 else None,
         f"antwort {i}" if i % 3 else None, "u" * 3, 1000 + i, '{"k":%d}' % i)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "ledger_id string, n int, entry_type string, outcome string, query_text string, "
        "generated_answer string, user_id_hash string, timestamp_ms bigint, metadata string")


def chained(spark, n=12, ledgers=2):
    return ledger.append_entries(inputs(spark, n, ledgers), ["n"]).withColumn(
        "signature", F.lit("s"))


def test_chain_matches_sequential_hashing(spark):
    rows = sorted(chained(spark).collect(), key=lambda r: (r["ledger_id"], r["sequence"]))
    previous = {}
    for row in rows:
        last, count = previous.get(row["ledger_id"], (GENESIS, 0))
        q, a = row["query_text"], row["generated_answer"]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        na = "not-applicable"
        payload = J.canonical_text({
            "previousHash": last, "sequence": count + 1, "entryType": row["entry_type"],
            "outcome": row["outcome"], "queryText": q, "querySha256": sha(q or ""),
            "retrievedChunks": [], "generatedAnswer": a,
            "generatedAnswerSha256": None if a is None else sha(a), "claimCitations": [],
            "modelVersion": na, "promptVersion": na, "embeddingModelVersion": na,
            "providerProfileId": na, "providerReplayCapability": "unsupported", "seed": None,
            "temperature": 0, "corpusSnapshotId": na, "corpusSnapshotHash": na, "promptHash": na,
            "timestampMs": row["timestamp_ms"], "userIdHash": "uuu",
            "metadata": json.loads(row["metadata"]),
        })
        assert row["canonical_payload"] == payload
        assert row["previous_hash"] == last and row["sequence"] == count + 1
        assert row["id"] == sha(last + payload)
        previous[row["ledger_id"]] = (row["id"], count + 1)


def test_append_continues_from_heads(spark):
    whole = {r["id"] for r in chained(spark, 12, 2).collect()}
    all_inputs = inputs(spark, 12, 2)
    first = ledger.append_entries(all_inputs.filter("n < 5"), ["n"])
    second = ledger.append_entries(all_inputs.filter("n >= 5"), ["n"], ledger.ledger_heads(first))
    assert {r["id"] for r in first.collect()} | {r["id"] for r in second.collect()} == whole


@pytest.mark.parametrize("bucket", [1, 3, 100])
def test_verification_finds_the_first_bad_row(spark, bucket):
    entries = chained(spark, 10, 1).cache()
    assert ledger.verify_entries(entries, bucket_rows=bucket).first().asDict() == {
        "ledger_id": "l0", "ok": True, "checked_rows": 10,
        "first_invalid_sequence": None, "reason": None}
    at = lambda s: F.col("sequence") == s
    cases = [
        (at(4), {"outcome": F.lit("provider-error")}, 4, "canonical payload mismatch"),
        (at(5), {"id": F.lit("f" * 64)}, 5, "row hash mismatch"),
        (at(6), {"previous_hash": F.lit(GENESIS)}, 6, "previous hash mismatch"),
        (at(7), {"signature": F.lit("")}, 7, "signature missing"),
        (at(2) | at(9), {"metadata": F.lit("{}")}, 2, "canonical payload mismatch"),
    ]
    for where, change, sequence, reason in cases:
        bad = ledger.tampered(entries, where, change)
        got = ledger.verify_entries(bad, bucket_rows=bucket).first()
        assert (got["ok"], got["checked_rows"], got["first_invalid_sequence"], got["reason"]) == (
            False, sequence - 1, sequence, reason)


def test_windowed_rows_fail_strict_verification(spark):
    part = ledger.window_entries(chained(spark, 10, 1), 1003, 1008)
    got = ledger.verify_entries(part).first()
    assert (got["checked_rows"], got["reason"]) == (0, "previous hash mismatch")
    assert part.count() == 6
    assert ledger.window_entries(chained(spark, 10, 1), 1003, 1008, ("report.generated",)).count() == 4


def test_rfc8032_vectors():
    vectors = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60",
         "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
         "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46b"
         "d25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb",
         "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
         "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c"
         "387b2eaeb4302aeeb00d291612bb0c00"),
    ]
    for seed, public, message, signature in vectors:
        seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
        assert ed25519.public_key(seed) == public
        assert ed25519.sign(seed, message) == signature
        assert ed25519.verify(public, message, signature)
        assert not ed25519.verify(public, message + b"x", signature)
        assert not ed25519.verify(public, message, signature[:-1] + b"\xff")


def test_signature_columns(spark):
    seed = hashlib.sha256(b"test").digest()
    frame = spark.createDataFrame([("a",), ("b",)], "m string").withColumn(
        "s", ed25519.signature_column(seed, F.col("m")))
    check = ed25519.verification_column(
        ed25519.public_key(seed), F.col("m"), F.when(F.col("m") == "b", F.lit("AA==")).otherwise(F.col("s")))
    rows = frame.withColumn("ok", check).collect()
    assert [r["ok"] for r in rows] == [True, False]
    assert len(base64.b64decode(rows[0]["s"])) == 64


def test_retrieved_chunk_json(spark):
    row = {"chunk_id": "c", "doc_id": "d", "source_document_id": "s", "source_type": "pdf",
           "source_path": "p", "page_start": 1, "page_end": 1, "char_start": 0, "char_end": 9,
           "token_start": 0, "token_end": 2, "chunk_index": 0, "chunk_text": 'x "y"',
           "chunk_sha256": "h", "corpus_snapshot_id": "i", "corpus_snapshot_hash": "j",
           "extraction_warnings": ["ocr-used"], "ocr_used": True, "retrieval_score": 0.03125,
           "retrieval_method": "rrf"}
    frame = spark.createDataFrame([row]).select(F.array(F.struct("*")).alias("c"))
    text = frame.select(ledger.retrieved_chunks_json(F.col("c"))).first()[0]
    parsed = json.loads(text)
    assert J.canonical_text(parsed) == text and parsed[0]["retrievalScore"] == 0.03125
    assert len(parsed[0]) == 20
    for value, want in ((1.0, "1"), (0.0, "0"), (0.000001, "0.000001"), (0.5, "0.5"), (10.0, "10")):
        assert spark.range(1).select(J.json_fixed6(F.lit(value))).first()[0] == want


def test_retention_view_changes_only_the_projection(spark):
    entries = chained(spark, 4, 1)
    tombs = spark.createDataFrame([("uuu", "gone")], "user_id_hash string, tombstone_hash string")
    rows = ledger.retention_view(entries, tombs).collect()
    assert {r["user_id_hash"] for r in rows} == {"gone"}
    meta = json.loads(rows[0]["metadata"])
    assert meta["operatorIdentityDeleted"] is True and meta["tombstoneHash"] == "gone" and "k" in meta
    assert '"userIdHash":"uuu"' in rows[0]["canonical_payload"]


def test_report_window_and_facts(spark):
    entries = chained(spark, 12, 1)
    since, until = report.iso_from_ms(1000), report.iso_from_ms(1011)
    facts = report.report_facts(entries, since, until).first()
    assert facts["query_volume"] == 8 and facts["refusal_rate"] == 0.0 and facts["model_versions"] == []
    empty = report.report_facts(entries, report.iso_from_ms(5), report.iso_from_ms(6)).first()
    assert empty["query_volume"] == 0 and empty["refusal_rate"] == 0.0
    with pytest.raises(ValueError):
        report.parse_window(until, since)
    with pytest.raises(ValueError):
        report.parse_iso_ms("yesterday", "since")
    assert report.window_label("2026-05-10T00:00:00Z", "2026-05-11T00:00:00Z") == (
        "2026-05-10T00:00:00.000Z..2026-05-11T00:00:00.000Z")


def test_replays_find_their_original(spark):
    entries = spark.createDataFrame(
        [("a", "query.answered", "answered", "{}"),
         ("b", "replay.passed", "replay-success", '{"originalLedgerEntryId":"a"}')],
        "id string, entry_type string, outcome string, metadata string")
    row = replay.replays_with_originals(entries).first()
    assert (row["original_id"], row["replay_id"], row["original_outcome"]) == ("a", "b", "answered")
