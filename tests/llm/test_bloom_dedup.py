import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.llm import bloom_dedup
from attestra.llm.queries import ORACLES, QUERIES
from checks import compare

SMALL = "/root/testdata/sf0.001"


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max(ids, key=lambda x: (x is not None, x or 0))
        out.append((i, keep, len(ids), i == keep))
    return Counter(out)


# A filter of few slots takes all rows for possible repeats; no room sends groups through a join.
@pytest.mark.parametrize("bits, groups", [(1 << 26, 1 << 19), (1 << 7, 1 << 19), (1 << 7, 0), (1 << 26, 0)])
def test_dedup_equals_brute_force(odd, odd_rows, bits, groups):
    got = bloom_dedup.dedup_exact(odd, filter_bits=bits, broadcast_groups=groups)
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == expected(odd_rows)


def test_without_copies_leaves_one_row_of_each_text(odd, odd_rows):
    rows = bloom_dedup.without_copies(odd)
    assert rows.columns == odd.columns
    kept = rows.collect()
    assert Counter(r.text or "" for r in kept) == Counter({t or "" for _, t in odd_rows})
    best = {t or "": keep for (i, t), (_, keep, _, _) in zip(odd_rows, [
        next(k for k in expected(odd_rows) if k[0] == i and k[2] == sum((x or "") == (t or "") for _, x in odd_rows))
        for i, t in odd_rows])}
    assert all(r.doc_id == best[r.text or ""] for r in kept)


def test_empty_table(empty):
    assert bloom_dedup.dedup_exact(empty).collect() == []
    assert bloom_dedup.without_copies(empty).collect() == []


def test_single_rows_are_not_grouped(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, F.lit("same"))
                                    .otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    words = bloom_dedup.repeated_slots(rows.select("text"), 1 << 26)
    possible = bloom_dedup.with_possible(rows, F.col("text"), words, 1 << 26)
    assert 700 <= possible.filter("_digest IS NOT NULL").count() <= 705
    got = bloom_dedup.dedup_exact(rows)
    assert got.filter("kept").count() == 1301
    assert got.filter("keep_id = 699 AND group_size = 700").count() == 700


def test_plan_has_no_python_and_moves_no_text(spark, odd):
    plan = bloom_dedup.dedup_exact(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def test_query_equals_sql(spark):
    got = QUERIES["op13_bloom_dedup"](spark, SMALL).toPandas()
    want = compare.connect(SMALL).execute(ORACLES["op13_bloom_dedup"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.normalized(got) == compare.normalized(want)
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    digests = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in texts}
    assert dict(zip(got.doc_id, got.text_sha256)) == digests
