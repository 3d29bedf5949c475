import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import dense, fusion, lexical, lexical_scan, served, topk
from attestra.plans import retrieval
from tests import model

WORDS = "recht pflicht muß inhalt system text person daten und der die das in von zu mit".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    texts = {}
    for i in range(n):
        size = rng.choice([0, 1, 3, 12, 30])
        texts[f"chunk_{rng.randrange(16**8):08x}{i:03d}"] = " ".join(
            rng.choice(WORDS[: rng.choice([4, 10, len(WORDS)])]) for _ in range(size)
        )
    return texts


QUERIES = {
    1: "Muss der Inhalt von Text und Daten mit System?",
    2: "Welche Pflicht und welches Recht hat eine Person",
    3: "völlig unbekannte Wörter",
    4: "",
    5: "die die die das",
}


def frames(spark, chunks, queries=QUERIES):
    return (
        spark.createDataFrame([(c, "p/" + c, t) for c, t in chunks.items()],
                              "chunk_id string, source_path string, chunk_text string"),
        spark.createDataFrame(list(queries.items()), "query_id int, query_text string"),
    )


@pytest.mark.parametrize("n", [1, 20, 130])
def test_candidates_match_model(spark, n):
    chunks = corpus(n)
    c, q = frames(spark, chunks)
    got = {}
    for row in lexical.lexical_candidates(c, q).collect():
        got.setdefault((row["query_id"], row["method"]), {})[row["rank"]] = (
            row["chunk_id"], row["score"])
    for qid, text in QUERIES.items():
        for method, want in zip(("dense", "bm25"), model.rankings(text, chunks), strict=True):
            assert [got[qid, method][r + 1] for r in range(len(want))] == want
            assert len(got[qid, method]) == min(50, n)


@pytest.mark.parametrize("trace", [True, False])
def test_evidence_and_gate_match_model(spark, trace):
    chunks = corpus(150, seed=3)
    c, q = frames(spark, chunks)
    found = retrieval.retrieve(c, q, trace=trace)
    evidence, gate = {}, {r["query_id"]: r for r in found.gate.collect()}
    for row in found.evidence.collect():
        evidence.setdefault(row["query_id"], []).append((row["rank"], row["chunk_id"], row["score"]))
    for qid, text in QUERIES.items():
        _, final, refused, best = model.retrieve(text, chunks)
        assert [(x[1], x[2]) for x in sorted(evidence.get(qid, []))] == final
        assert gate[qid]["out_of_corpus"] == refused
        assert gate[qid]["best_evidence"] == pytest.approx(best)
    refused = {r["query_id"]: r["out_of_corpus"] for r in found.refused.collect()}
    assert refused == {q: r["out_of_corpus"] for q, r in gate.items()}


def test_shuffled_path_equals_broadcast_path(spark):
    c, q = frames(spark, corpus(120, seed=5))
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(lexical.lexical_candidates(c, q)) == key(
        lexical.lexical_candidates(c, q, broadcast_rows=0)
    )


def test_lists_equal_all_pairs(spark, monkeypatch):
    """Questions of common words only, and blocks of a few queries, against the pair-wise scores."""
    rng = random.Random(4)
    words = ["und", "der", "die", "das"] + [f"wort{i}" for i in range(40)]
    weights = [30, 25, 20, 15] + [1] * 40
    chunks = {f"c{i:03d}": " ".join(rng.choices(words, weights, k=rng.randrange(3, 30))) for i in range(150)}
    asked = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 7)))) for i in range(12)]
    c = spark.createDataFrame([(k, "p", v) for k, v in chunks.items()],
                              "chunk_id string, source_path string, chunk_text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, query_text string")
    given = lexical.scoring_input(c, q)
    pairs = lexical.score_pairs(given).collect()
    for size, most in ((lexical_scan.WEIGHT_ROWS, lexical_scan.PAIRS), (10, 40)):
        # The task function takes the bound of its module with it.
        monkeypatch.setattr(lexical_scan, "PAIRS", most)
        lists = lexical_scan.scan_lists(given.postings, given.weights, 7, ("dense", "bm25"),
                                        (lexical.MAX_DENSITY, lexical.MIN_LENGTH, 6), weight_rows=size)
        got = {}
        for r in lexical.merged_lists(lists, 7).collect():
            got.setdefault((r["query_id"], r["method"]), []).append((-r["score"], r["chunk_id"]))
        want, best = {}, {}
        for r in pairs:
            want.setdefault((r["query_id"], "dense"), []).append((-r["coverage"], r["chunk_id"]))
            want.setdefault((r["query_id"], "bm25"), []).append((-r["evidence"], r["chunk_id"]))
            best[r["query_id"]] = max(best.get(r["query_id"], 0.0), r["evidence"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:7] for k, v in want.items()}
        assert {r["query_id"]: r["best"] for r in lexical.best_evidence(lists).collect()} == best


def test_supplied_scores_below_zero(spark):
    c = spark.createDataFrame([(x, "p", "text") for x in "abcdef"], "chunk_id string, source_path string, chunk_text string")
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query_text string")
    scores = spark.createDataFrame(
        [(1, "a", "p", -0.5), (1, "b", "p", 0.4), (1, "c", "p", -0.1), (2, "a", "p", -0.2), (2, "b", "p", 0.0)],
        "query_id int, chunk_id string, source_path string, score double")
    got = retrieval.dense_candidates(scores, c, q, 5).orderBy("query_id", "rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == 1] == [
        ("b", 0.4), ("d", 0.0), ("e", 0.0), ("f", 0.0), ("c", -0.1)]
    assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == 2] == [
        ("b", 0.0), ("c", 0.0), ("d", 0.0), ("e", 0.0), ("f", 0.0)]
    three = c.filter("chunk_id < 'd'")
    got = retrieval.dense_candidates(scores, three, q, 5).filter("query_id = 1").orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "c", "a"]


def test_dense_scores_reorder_but_never_open_the_gate(spark):
    chunks = corpus(80, seed=7)
    c, q = frames(spark, chunks)
    for value in (1.0, 0.0):
        rows = [(i, k, "p/" + k, value) for i in QUERIES for k in chunks]
        scores = spark.createDataFrame(
            rows, "query_id int, chunk_id string, source_path string, score double")
        found = retrieval.retrieve(c, q, dense_scores=scores)
        gate = {r["query_id"]: r["out_of_corpus"] for r in found.gate.collect()}
        cited = {}
        for r in found.evidence.collect():
            cited.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
        for qid, text in QUERIES.items():
            _, final, refused, _ = model.retrieve(text, chunks, dense=dict.fromkeys(chunks, value))
            assert gate[qid] == refused
            assert [(x[1], x[2]) for x in sorted(cited.get(qid, []))] == final


def test_no_cross_join_and_no_second_scan_exchange(spark):
    c, q = frames(spark, corpus(60))
    plan = lexical.evidence_candidates(c, q)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_fanout_keeps_top_k(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(50), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k int, score int, id int").repartition(7)
    order = [F.col("score").desc(), F.col("id").asc()]
    one = topk.top_k(frame, ["k"], order, 20).collect()
    many = topk.top_k(frame, ["k"], order, 20, fanout=5).collect()
    assert sorted(one) == sorted(many) and len(one) == 60


def test_top_k_argument():
    assert fusion.parse_top_k(None) == 8 and fusion.parse_top_k(20) == 20
    for bad in (0, 21, 1.5, True, "3"):
        with pytest.raises(ValueError):
            fusion.parse_top_k(bad)


def test_fusion_scores(spark):
    rows = [(1, "dense", 1, "a", "p", 0.9), (1, "bm25", 1, "a", "p", 0.5), (1, "bm25", 2, "b", "p", 0.2)]
    cand = spark.createDataFrame(
        rows, "query_id int, method string, rank int, chunk_id string, source_path string, score double")
    got = {r["chunk_id"]: r["score"] for r in fusion.reciprocal_rank_fusion(cand).collect()}
    assert got == {"a": round(2 / 61, 6), "b": round(1 / 62, 6)}


def test_non_finite_scores_cannot_open_the_served_gate(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "dense", 1, "a", "p", nan), (1, "bm25", 1, "a", "p", 0.0), (2, "dense", 1, "a", "p", inf),
            (3, "dense", 1, "a", "p", -0.2), (4, "dense", 1, "a", "p", 0.4)]
    cand = spark.createDataFrame(
        rows, "query_id int, method string, rank int, chunk_id string, source_path string, score double")
    queries = spark.createDataFrame([(i, "") for i in range(1, 6)], "query_id int, query_text string")
    got = {r["query_id"]: r["out_of_corpus"] for r in fusion.served_gate(queries, cand).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}


def test_cosine_top_k_blocks_and_ties(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[vectors.sum(axis=1) == 0] += 1
    vectors[50:150] = vectors[50]
    queries = np.vstack([vectors[50], rng.normal(size=(4, 8))])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)],
                              "id int, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)],
                              "query_id int, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    scores = np.round(unit(vectors) @ unit(queries).T, 6)
    for matrix_bytes in (1 << 20, 128):
        got = {}
        for r in dense.cosine_top_k(v, q, 50, matrix_bytes).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
        for j in range(len(queries)):
            want = sorted(range(300), key=lambda i: (-scores[i, j], i))[:50]
            assert [got[j][r] for r in range(1, 51)] == want


def test_cosine_rejects_zero_and_ragged(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    for bad in ([0.0, 0.0], [1.0]):
        v = spark.createDataFrame([(1, bad)], "id int, vector array<double>")
        with pytest.raises(Exception, match="cosine"):
            dense.cosine_top_k(v, q).collect()


def test_cover_density(spark):
    rng = random.Random(4)
    cases = [("beleg " * n, "beleg") for n in (1, 5, 20)]
    cases += [("audit " * 3, "audit beleg"), ("audit beleg", "audit beleg")]
    cases += [(" ".join(rng.choice("abcd") * 2 for _ in range(30)), "aa bb") for _ in range(12)]
    cases += [(" ".join(rng.choice("abcdef") * 2 for _ in range(60)), "dd aa cc bb aa") for _ in range(12)]
    cases += [(" ".join(rng.choice("abc") * 2 for _ in range(9)), "cc") for _ in range(3)]
    chunks = {f"c{i:02d}": text for i, (text, _) in enumerate(cases)}
    queries = {i: q for i, (_, q) in enumerate(cases)}
    c, q = frames(spark, chunks, queries)
    wanted = served.wanted_lexemes(q)
    got = {(r["query_id"], r["chunk_id"]): r["score"]
           for r in served.covers(served.asked_hits(c, wanted), wanted).collect()}
    for i, (_, asked) in enumerate(cases):
        for cid, text in chunks.items():
            want = model.cover_density(text.split(), sorted(set(asked.split())))
            assert got.get((i, cid), 0.0) == pytest.approx(want), (i, cid)
    assert got[0, "c00"] == 0.1 and got[0, "c01"] == 0.5 and got[0, "c02"] == 2.0
    assert (3, "c03") not in got and got[4, "c04"] == 0.1


def test_served_path_refuses_without_evidence(spark):
    chunks = {f"c{i}": t for i, t in enumerate(["alpha beta gamma", "delta epsilon", "zeta"])}
    c, q = frames(spark, chunks, {1: "alpha beta gamma", 2: "qqqq wwww"})
    found = retrieval.retrieve_served(c, q, 64, top_k=2)
    gate = {r["query_id"]: r["out_of_corpus"] for r in found.gate.collect()}
    kept = found.evidence.collect()
    assert gate[1] is False and {r["query_id"] for r in kept} == {k for k in gate if not gate[k]}
    assert next(r for r in kept if r["query_id"] == 1 and r["rank"] == 1)["chunk_id"] == "c0"


def test_source_chunks_of_many_requests(spark):
    rng = random.Random(3)
    rows, asked = [], []
    for d in range(6):
        start = 0
        for i in range(rng.randrange(1, 12)):
            # Starts may repeat and fall back, as repeated text is found at its first place.
            rows.append((f"d{d}", i, f"d{d}c{i}", start))
            start = max(0, start + rng.choice([0, 40, 900, 5000, -30]))
        asked += [(f"d{d}", o) for o in {0, *(rng.randrange(9000) for _ in range(40))}]
    asked += [("nothing", 5), ("d1", -7), ("d1", 10**7)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_id string, char_start int")
    requests = spark.createDataFrame(asked, "doc_id string, offset int")
    for width in (64, 4096):
        got = {(r["doc_id"], r["offset"]): r["chunk_id"]
               for r in retrieval.find_source_chunks(chunks, requests, width).collect()}
        for d, o in asked:
            want = next((c for e, _, c, s in rows if e == d and s >= o), None)
            assert got[d, o] == want, (d, o)
