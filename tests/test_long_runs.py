"""Queries where a caption holds a chunk of more units than any fixed number, against their SQL twins."""

import duckdb
import pandas as pd
import pytest

from spanwright.plans import registry
from test_queries import plain

#: (event_id, hour, user_id, event_type, value); a value of 36 lasts an hour.
EVENTS = [
    *[(k, 48 + 2 * k, 1, "view" if k % 2 else "click", 54.0) for k in range(1, 13)], (20, 50, 1, "signup", 846.0), (21, 52, 1, "purchase", 72.0),
    *[(30 + k, 10 + k, 2, "view", 36.0) for k in range(9)], (40, 12, 2, "purchase", 216.0), (41, 16, 2, "signup", 252.0), (42, 90, 2, "error", 36.0),
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    where, con = tmp_path_factory.mktemp("long-runs"), duckdb.connect()
    rows = ", ".join(f"({i}::bigint, timestamp '2024-01-01' + interval {h} hour, {u}::bigint, '{k}', {v}::double, '{{}}')" for i, h, u, k, v in EVENTS)
    con.execute(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{where}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{where}/events.parquet'")
    return str(where), con


def check(spark, tables, name):
    where, con = tables
    got = plain(registry.QUERIES[name](spark, where).toPandas())
    pd.testing.assert_frame_equal(got, plain(con.execute(registry.ORACLE_SQL[name]).df()), check_dtype=False)
    return got


def test_class_scores(spark, tables):
    got = check(spark, tables, "class_scores")
    # all twelve units of the first stream are matched, not six of them at most
    assert got["matched_share"].astype(float).max() == 1


def test_edge_error_types(spark, tables):
    got = check(spark, tables, "edge_error_types")
    assert got[(got["side"] == "unit") & (got["type"] == "joined")]["n"].astype(int).max() >= 12
