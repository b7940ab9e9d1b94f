"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from speechframe.operators.ordered import HOT_ROWS_SETTING

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    result = compare(spark, con, name, queries()[name], SQL.get(name), SMALL)
    assert not result.startswith("FAIL"), result


ORDERED = """merge_regions pack_chunks plan_violations chunk_coverage group_words segment_spans segment_texts seams near_seam_errors
seam_coverage asof_duplicate rate_limit admission batch_files job_lifecycle stalls breaker_timeline
outbox_state concurrency sessions""".split()


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_hot_keys(spark, con, name):
    """The same results when almost every key counts as hot."""
    spark.conf.set(HOT_ROWS_SETTING, "40")
    try:
        result = compare(spark, con, name, queries()[name], SQL[name], SMALL)
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    assert not result.startswith("FAIL"), result


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "text", "kept", "dropped"]


def test_keys_agree():
    assert set(SQL) <= set(queries())
