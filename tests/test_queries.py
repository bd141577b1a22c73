"""Registered queries against their SQL on the smallest tables.

A selection by default; ALL_QUERIES=1 runs every query.
"""

import os

import pytest
from oracle import connect, mismatch

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "calc_times_interval", "calc_times_point", "scale_features_inter", "encode_log", "role_table",
    "split_auto", "split_auto_fallback", "trace_series", "ngram_samples_ctx", "negative_samples",
    "dialogue_ngrams", "log_dl", "cycle_mae", "pool_occupancy", "generated_log",
)
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
CHOSEN = list(QUERIES) if os.environ.get("ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert mismatch(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["task", "events", "dur", "wait", "acc_cycle"]


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
