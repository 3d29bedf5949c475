import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import toxicity
from attestra.llm.queries import vocabulary_path
from tests.llm.test_text_operators import groups_of, hits_of, lines_kept

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        result = spark.read.parquet(str(folder / name))
        out[name] = (docs, result)
        docs = result
    return out


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    kept = {r.doc_id for r in after.collect()}
    judged = toxicity.score_toxicity(before, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert kept == {r.id for r in judged if not r.toxic}


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = {(i, text): n for (i, text, _, _), n in lines_kept(rows(before)).items()}
    assert {x: 1 for x in rows(after)} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["similarity_join"]
    want = {i for i, group, _ in groups_of(rows(before)) if i == group}
    assert {i for i, _ in rows(after)} == want


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = set()
    for i, text in rows(before):
        n, hit, _ = hits_of(text, items)
        if not (hit and 20 * hit >= n):
            want.add(i)
    assert {i for i, _ in rows(after)} == want


def test_packed_tokens(stages):
    import numpy as np
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in rows(before)}
    seen = {i: 0 for i in ids}
    for r in sorted(after.collect(), key=lambda r: (r.doc_id, r.start)):
        assert seen[r.doc_id] == r.start and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert all(seen[i] == len(x) for i, x in ids.items())


def test_run_gives_the_stages_result(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = stages["packing"][1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_odd_rows_pass(spark, odd, odd_rows):
    docs = odd.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.collect()} >= {None, 1, 4, 5, 9, 10}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= len(odd_rows)
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0
