"""Every batch query against its SQL on the smallest tables; streams have their own test."""

import pytest

from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


def names():
    from cuelake.plans.oracles import SQL
    return [n for n in SQL if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    assert difference(spark, con, queries()[name], oracle_sql()[name], FOLDER) is None


@pytest.mark.parametrize("name", ["stream_ocr_gate", "stream_late_audit", "stream_cues", "stream_late_samples", "stream_progress"])
def test_stream_equals_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    assert difference(spark, con, queries()[name], oracle_sql()[name], FOLDER) is None


def test_entry_and_keys(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from cuelake.plans.queries import QUERIES
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
