"""Queries with spans of no length, and other rows that the smallest tables lack, against their SQL twins."""

import duckdb
import pandas as pd
import pytest

from spanwright.plans import registry
from test_queries import plain

#: (event_id, hour, user_id, event_type, value); a value of 36 lasts an hour.
EVENTS = [
    (1, 1, 1, "view", 720.0), (2, 5, 1, "signup", 0.0), (3, 30, 1, "purchase", 360.0), (4, 33, 1, "click", 0.0), (5, 50, 1, "error", 360.0),
    (6, 53, 1, "view", 0.0), (7, 90, 1, "click", 36.0), (8, 120, 1, "signup", 360.0), (9, 3, 2, "view", 0.0), (10, 2, 2, "purchase", 72.0), (11, 40, 2, "click", 0.0),
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    where, con = tmp_path_factory.mktemp("empty-spans"), duckdb.connect()
    rows = ", ".join(f"({i}::bigint, timestamp '2024-01-01' + interval {h} hour, {u}::bigint, '{k}', {v}::double, '{{}}')" for i, h, u, k, v in EVENTS)
    con.execute(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{where}/events.parquet' (format parquet)")
    pages = "(1::bigint, 'a &amp b &ltc'), (2, 'x &amp;amp y &lt;i&gt;z'), (3, null)"
    con.execute(f"copy (select * from (values {pages}) t(page_id, html)) to '{where}/pages.parquet' (format parquet)")
    for name in ("events", "pages"):
        con.execute(f"create view {name} as select * from '{where}/{name}.parquet'")
    return str(where), con


@pytest.mark.parametrize("name", ["uncaptioned_units", "edge_error_types", "chunk_class_units", "class_scores", "marked_units", "segment_units", "source_events", "clean_captions"])
def test_equals_sql(spark, tables, name):
    where, con = tables
    got = plain(registry.QUERIES[name](spark, where).toPandas())
    pd.testing.assert_frame_equal(got, plain(con.execute(registry.ORACLE_SQL[name]).df()), check_dtype=False)
