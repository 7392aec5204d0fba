"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    ok, message, _ = compare(spark, con, FOLDER, key, QUERIES[key], ORACLES.get(key))
    assert ok, message


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "action", "masked_output", "unmasked", "regex_findings", "pii_entities", "secret_confidence", "ml_confidence", "sources"]
    assert df.filter("unmasked").count() == 0
    assert df.count() == 200


@pytest.mark.parametrize("key", ["entity_prf", "entity_prf_averages", "top_entities_by_f1", "entity_counts_true_vs_pred"])
def test_entities_are_searched_once(spark, key):
    """Gold and predicted spans come from one search of the texts, which is over when they are compared."""
    plan = entry.queries()[key](spark, entry.SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan
