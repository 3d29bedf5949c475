"""A cross-section of the registered queries against their SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_point
from checks import compare
from checks.oracle import ORACLES
from checks.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize(
    "name", ["text_terms", "chunk_records", "corpus_snapshot", "cited_evidence", "ledger_append",
             "attempt_limits_per_user", "report_facts", "html_article"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = compare.connect(SMALL).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.normalized(got) == compare.normalized(want)


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
