import hashlib

import pytest
from pyspark.sql import functions as F

from attestra.operators import chunking, snapshots
from tests import model


def revisions(spark, texts):
    rows = [(f"p/{i}", "markdown", hashlib.sha256(t.encode()).hexdigest(), t, False, [])
            for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "source_path string, source_type string, content_sha256 string, text string, "
        "ocr_used boolean, warnings array<string>",
    )


TEXTS = [
    "", "   ", "one", "a b c", "a b c d", "a b c d e f g h i j k", "dup dup dup dup dup dup",
    "wide  gaps\n\nhere and 😀 more\tof it", "x " * 50,
]


def test_windows_match_model(spark):
    for window, overlap in ((3, 1), (4, 0), (2, 5), (800, 100)):
        got = chunking.token_windows(revisions(spark, TEXTS), window, overlap).collect()
        want = [
            (f"p/{i}", n, s, e, t)
            for i, text in enumerate(TEXTS)
            for n, (s, e, t) in enumerate(model.windows(text, window, overlap))
        ]
        assert sorted(
            (r["source_path"], r["chunk_index"], r["token_start"], r["token_end"], r["chunk_text"])
            for r in got
        ) == sorted(want)


def test_offsets_point_at_the_source(spark):
    got = chunking.token_windows_with_offsets(revisions(spark, TEXTS), 3, 1).collect()
    for row in got:
        text = TEXTS[int(row["source_path"][2:])]
        units = text.encode("utf-16-le")
        piece = units[2 * row["char_start"] : 2 * row["char_end"]].decode("utf-16-le")
        assert model.split_blanks(piece) == row["chunk_text"].split(" ")
        first = text.find(row["chunk_text"])
        if first >= 0:
            assert row["char_start"] == len(text[:first].encode("utf-16-le")) // 2


def test_snapshot_identity(spark):
    texts = ["a b c d e", "second"]
    row = snapshots.snapshot_row(revisions(spark, texts), 4, window=3, overlap=1).first()
    base = snapshots.corpus_digest(revisions(spark, texts)).first()["base_hash"]
    assert row["base_hash"] == base and row["chunk_count"] == 3
    assert row["snapshot_hash"] == hashlib.sha256(f"{base}:3".encode()).hexdigest()
    assert row["id"] == "snap_" + hashlib.sha256(f"4\0{base}".encode()).hexdigest()[:24]
    empty = snapshots.snapshot_row(revisions(spark, [""]), 1).first()
    assert empty["snapshot_hash"] == empty["base_hash"] and empty["chunk_count"] == 0


def test_digest_moves_with_content_and_not_with_size(spark):
    digest = lambda t, **kw: snapshots.corpus_digest(revisions(spark, t), **kw).first()
    first, again, other = digest(["a", "b", "c"]), digest(["a", "b", "c"]), digest(["a", "b", "x"])
    assert first["digest_kind"] == "tree"
    assert first["base_hash"] == again["base_hash"] != other["base_hash"]
    assert digest(["a", "b"], kind="flat")["digest_kind"] == "flat"
    with pytest.raises(ValueError):
        digest(["a"], kind="other")
    # Hashes by hand, for few and for many documents: the rule is the same.
    for n in (3, 700):
        paths = {f"d/{i}": hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)}
        frame = spark.createDataFrame(list(paths.items()), "source_path string, content_sha256 string")
        leaves = {}
        for path in sorted(paths):
            leaves.setdefault(hashlib.sha256(path.encode()).hexdigest()[:4], []).append(paths[path])
        leaf = [hashlib.sha256("|".join(leaves[b]).encode()).hexdigest() for b in sorted(leaves)]
        want = hashlib.sha256("|".join(leaf).encode()).hexdigest()
        assert snapshots.corpus_digest(frame).first()["base_hash"] == want
        flat = hashlib.sha256("|".join(paths[p] for p in sorted(paths)).encode()).hexdigest()
        assert snapshots.corpus_digest(frame, "flat").first()["base_hash"] == flat


def test_provenance(spark):
    sources = spark.createDataFrame([(1, "(1) Alpha. (2) Beta."), (2, "Alpha. rest"), (3, "B A")],
                                    "source_id int, text string")
    chunks = spark.createDataFrame(
        [(1, 0, "Alpha."), (1, 1, "Beta."), (2, 0, "Alpha."), (3, 0, "A"), (3, 1, "B")],
        "source_id int, chunk_index int, chunk_text string",
    )
    got = {r["source_id"]: (r["verbatim"], r["n_missing"])
           for r in snapshots.provenance(sources, chunks).collect()}
    assert got == {1: (True, 0), 2: (False, 0), 3: (False, 1)}


def test_fixture_hash_moves(spark):
    def digest(rows, **kw):
        frame = spark.createDataFrame(rows, "chunk_id string, chunk_text string")
        return snapshots.fixture_corpus_hash(frame, **kw).first()["corpus_hash"]

    base = [("a", "x"), ("b", "y")]
    assert digest(base) == digest(base[::-1])
    assert len({digest(base), digest([("a", "x!"), ("b", "y")]), digest([("c", "x"), ("b", "y")])}) == 3
    assert digest(base, kind="flat") != digest([("a", "x!"), ("b", "y")], kind="flat")


def test_window_count_matches(spark):
    frame = revisions(spark, TEXTS)
    counted = frame.select(
        "source_path", snapshots.window_count(F.col("text"), 3, 1).alias("n")
    ).collect()
    for row in counted:
        assert row["n"] == len(model.windows(TEXTS[int(row["source_path"][2:])], 3, 1))
