"""Every registered query against its SQL twin; those without one give rows."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
EMPTY_HERE = {"over_limit", "dedup_basic", "eviction_log", "message_overhead", "viral_protection", "victim_choice", "dedup_latency"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, sf).count() > 0
        return
    found = differences(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)
    if name in EMPTY_HERE and found == "no rows on either side":
        return
    assert found == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "window_index"
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
