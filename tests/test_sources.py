import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.functions import ed25519
from attestra.operators import ledger
from attestra.sources import corpus_files, fixtures, json_lines
from attestra.sources.ledger_store import LedgerStore, sealed_digest
from attestra.sources.snapshot_store import SnapshotStore
from attestra.streaming.ledger_sink import append_stream
from attestra.streaming.limiter import attempt_stream
from tests import model
from tests.test_chunking import revisions
from tests.test_ledger import inputs


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:p>{text}</w:p>")
    return out.getvalue()


def test_directory_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("Ä hidden-text\r\nzwei\0".encode())
    (tmp_path / "sub" / "b.DOCX").write_bytes(docx("Hallo &amp; Welt"))
    (tmp_path / "c.docx").write_bytes(b"plain words")
    (tmp_path / "d.pdf").write_bytes(b"%PDF scanned-pdf text")
    (tmp_path / "e.docX").write_bytes(docx("odd"))
    (tmp_path / "f.mD").write_bytes(b"odd")
    (tmp_path / "skip.txt").write_bytes(b"no")
    (tmp_path / "_hidden.md").write_bytes(b"no")
    rows = {r["source_path"].rsplit("/", 1)[1]: r
            for r in corpus_files.read_revisions(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "b.DOCX", "c.docx", "d.pdf", "e.docX", "f.mD"}
    assert rows["a.md"]["text"] == "Ä hidden-text\nzwei"
    assert rows["a.md"]["warnings"] == ["hidden-text-warning"]
    assert rows["b.DOCX"]["text"] == "Hallo & Welt" and rows["b.DOCX"]["warnings"] == []
    assert rows["c.docx"]["warnings"] == ["docx-text-fallback"]
    assert rows["d.pdf"]["ocr_used"] and rows["d.pdf"]["warnings"][-1] == "ocr-used"


def test_root_is_enforced(tmp_path):
    inside = corpus_files.assert_inside_root(str(tmp_path / "x"), str(tmp_path))
    assert inside.endswith("/x")
    for bad in (str(tmp_path) + "-other", str(tmp_path / ".." / "y")):
        with pytest.raises(ValueError):
            corpus_files.assert_inside_root(bad, str(tmp_path))


GOOD = {"id": "a", "question": "Q", "expected_outcome": "answered", "tags": ["t"]}


@pytest.mark.parametrize(
    ("lines", "match"),
    [
        ([], "empty"),
        ([{**GOOD, "id": None}], "ID"),
        ([GOOD, GOOD], "Duplicate"),
        ([{**GOOD, "question": ""}], "question"),
        ([{**GOOD, "expected_outcome": "maybe"}], "expected_outcome"),
    ],
)
def test_golden_reader_is_strict(spark, tmp_path, lines, match):
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    with pytest.raises(ValueError, match=match):
        json_lines.read_golden(spark, str(path))


def test_readers_accept_good_rows(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text(json.dumps(GOOD) + "\n\n" + json.dumps({**GOOD, "id": "b"}))
    assert json_lines.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 2
    probe = {"id": "p", "class": "in-corpus", "question": "q", "note": "n"}
    (tmp_path / "p.jsonl").write_text(json.dumps(probe))
    assert json_lines.read_probes(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "p.jsonl").write_text(json.dumps({**probe, "class": "other"}))
    with pytest.raises(ValueError, match="class"):
        json_lines.read_probes(spark, str(tmp_path / "p.jsonl"))


def cache_file(path, vectors, dimension=2):
    path.write_text(json.dumps({
        "provenance": {"embeddingModelVersion": "m", "endpointConfigHash": "h",
                       "dimension": dimension, "generatedAt": "now", "textCount": len(vectors)},
        "vectors": vectors}, indent=1))


def test_vector_cache(spark, tmp_path):
    import hashlib
    key = hashlib.sha256(b"hello").hexdigest()
    path = tmp_path / "cache.json"
    cache_file(path, {key: [0.6, 0.8]})
    cache = json_lines.read_vector_cache(spark, str(path))
    texts = spark.createDataFrame([("hello",)], "text string")
    assert json_lines.lookup_vectors(texts, cache).first()["vector"] == [0.6, 0.8]
    with pytest.raises(Exception, match="no cached embedding"):
        json_lines.lookup_vectors(spark.createDataFrame([("miss",)], "text string"), cache).collect()
    for bad in ([1.0], [0.0, 0.0]):
        cache_file(path, {key: bad})
        with pytest.raises(ValueError, match="unusable"):
            json_lines.read_vector_cache(spark, str(path))
    for text, message in (('{"vectors": {}}', "provenance"), ('{"provenance": {"dimension": 2}}', "vectors"),
                          ('{"provenance": {"dimension": 2}, "vectors": {"a": [1, 2], "b" 3}}', "not a vector cache")):
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            json_lines.read_vector_cache(spark, str(path))
    path.write_text('{"vectors": {}, "provenance": {"dimension": 2}}')
    assert json_lines.read_vector_cache(spark, str(path)).collect() == []


def test_vector_cache_is_read_by_several_tasks(spark, tmp_path):
    vectors = {f"{i:064x}": [i + 0.5, -1e-7, float(i % 3)] for i in range(3000)}
    path = tmp_path / "cache.json"
    cache_file(path, vectors, 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    cache = json_lines.read_vector_cache(spark, str(path))
    assert cache.select(F.spark_partition_id()).distinct().count() > 3
    assert {r["text_sha256"]: r["vector"] for r in cache.collect()} == vectors
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    missed = json_lines.cache_misses(spark.createDataFrame([("hello",)], "text string"), cache)
    assert [r["text"] for r in missed.collect()] == ["hello"]


def test_fixture_corpus(spark, tmp_path):
    (tmp_path / "a.md").write_text("# head\n<!-- chunk:one -->\n Erster \n<!-- chunk:two -->\nZwei\n")
    chunks = fixtures.load_fixture_corpus(spark, str(tmp_path))
    assert [(r["chunk_id"], r["chunk_text"]) for r in chunks.orderBy("chunk_index").collect()] == [
        ("one", "Erster"), ("two", "Zwei")]
    (tmp_path / "b.md").write_text("<!-- chunk:one -->\nagain")
    with pytest.raises(ValueError, match="one"):
        fixtures.load_fixture_corpus(spark, str(tmp_path))


def test_ingest_life_cycle(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    first = revisions(spark, ["a b c d e", "second text"])
    dry = store.ingest(first, dry_run=True)
    assert dry.dry_run and dry.changed_document_count == 2 and dry.chunk_count == 2 and not dry.activated
    one = store.ingest(first)
    assert one.activated and store.active_snapshot().first()["id"] == one.snapshot_id
    assert one.estimated_index_bytes == 2 * 4160
    again = store.ingest(first)
    assert again.no_op and not again.activated and again.chunk_count == 0
    assert again.snapshot_id == one.snapshot_id
    # A deletion alone changes nothing.
    assert store.ingest(revisions(spark, ["a b c d e"])).no_op
    changed = revisions(spark, ["a b c d e", "second text, revised"])
    failed = store.ingest(changed, fail_after_extract=True)
    assert not failed.activated and failed.changed_document_count == 1
    assert store.active_snapshot().first()["id"] == one.snapshot_id
    two = store.ingest(changed)
    assert two.activated and two.snapshot_id != one.snapshot_id
    statuses = [(r["sequence"], r["status"]) for r in store.snapshots().orderBy("sequence").collect()]
    assert statuses == [(1, "active"), (2, "failed"), (3, "active")]
    texts = {r["chunk_text"] for r in store.chunks(two.snapshot_id).collect()}
    assert texts == {"a b c d e", "second text, revised"}
    assert {r["corpus_snapshot_id"] for r in store.chunks(one.snapshot_id).collect()} == {one.snapshot_id}
    attempts = {r["id"]: r["attempt"] for r in store.snapshots().collect()}
    assert all(attempts[two.snapshot_id] in f for f in store.chunks(two.snapshot_id).inputFiles())


SEED = bytes(range(32))


def test_ledger_store(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), SEED)
    everything = inputs(spark, 9, 2)
    assert store.append(everything.filter("n < 4"), ["n"]) == 0
    assert store.append(everything.filter("n >= 4"), ["n"]) == 1
    # A batch that is committed stays as it is.
    store.append(everything.filter("n >= 4"), ["n"], batch=1)
    entries = store.entries()
    assert entries.count() == 9
    whole = {r["id"] for r in ledger.append_entries(everything, ["n"]).collect()}
    assert {r["id"] for r in entries.collect()} == whole
    assert all(r["ok"] for r in store.verify().collect())
    some = entries.first()["id"]
    assert store.find(some).count() == 1
    assert store.append(everything, ["n"], batch=0) == 0 and store.entries().count() == 9
    forged = LedgerStore(spark, store.path, bytes(32))
    assert {r["reason"] for r in forged.verify().collect()} == {"signature mismatch"}
    manifest = store.export_sealed(str(tmp_path / "out"), 1002, 1007, ("report.generated",), seal_rows=2)
    assert manifest["rowCount"] == 4 and manifest["privateKeysIncluded"] is False
    assert sealed_digest(spark, str(tmp_path / "out"), 2) == manifest["ledgerSha256"]
    assert sealed_digest(spark, str(tmp_path / "out"), 3) != manifest["ledgerSha256"]
    ranges = spark.read.parquet(str(tmp_path / "out" / "ranges")).collect()
    assert sum(r["rows"] for r in ranges) == 4 and max(r["rows"] for r in ranges) <= 2
    again = store.export_sealed(str(tmp_path / "again"), 1002, 1007, ("report.generated",), seal_rows=2)
    assert again == manifest
    body = spark.read.text(str(tmp_path / "out" / "manifest")).first()[0]
    import base64
    signature = base64.b64decode(spark.read.text(str(tmp_path / "out" / "signature")).first()[0])
    assert ed25519.verify(store.public_key, body.encode(), signature)


def test_streamed_ledger_and_limits(spark, tmp_path):
    source = str(tmp_path / "in")
    inputs(spark, 8, 2).repartitionByRange(2, "n").sortWithinPartitions("n").write.parquet(source)
    schema = spark.read.parquet(source).schema
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = append_stream(stream, store, ["n"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    entries = store.entries()
    assert entries.count() == 8 and entries.select("batch").distinct().count() == 2
    signed = entries.withColumn("signature", F.lit("x"))
    assert all(r["ok"] for r in ledger.verify_entries(signed).collect())


def test_streamed_attempts(spark, tmp_path):
    rows = [(i, i % 2, t) for i, t in enumerate([0, 0, 1, 1, 2, 2, 3, 3, 90, 100, 101, 101, 102, 250])]
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, "event_id bigint, k bigint, ts_ms bigint")
    frame.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    out = attempt_stream(stream, "k", window_ms=100, limit=3)
    query = (out.writeStream.format("memory").queryName("attempts").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(processingTime="1 second").start())
    # Pending state timeouts keep the query busy, so wait for the rows, not for idleness.
    deadline = time.time() + 60
    while time.time() < deadline and spark.table("attempts").count() < len(rows):
        time.sleep(0.5)
    query.stop()
    got = {r["event_id"]: r["allowed"] for r in spark.table("attempts").collect()}
    assert [got[i] for i in range(len(rows))] == model.attempts([(k, t) for _, k, t in rows], 100, 3)
