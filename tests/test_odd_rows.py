"""Queries over events with repeated or missing ids and missing times, against their SQL twins."""

import duckdb
import pandas as pd
import pytest

from spanwright.plans import registry
from test_queries import plain

#: (event_id, hour, user_id, event_type, value); a value of 36 lasts an hour.
TABLES = {
    "repeated ids": [
        (1, 10, 1, "view", 360), (2, 11, 1, "signup", 36), (1, 60, 1, "view", 360), (3, 120, 1, "click", 360), (7, 120, 1, "purchase", 360),
        (4, 300, 1, "click", 360), (7, 300, 1, "purchase", 360), (5, 350, 1, "error", 36),
    ],
    "missing ids": [
        (None, 10, 1, "view", 360), (1, 12, 1, "error", 36), (None, 60, 1, "click", 360), (None, 60, 1, "signup", 360), (2, 100, 1, "view", 360),
    ],
    "missing times": [
        (1, None, 1, "view", 360), (2, 10, 1, "view", 360), (3, 60, 1, "error", 36), (4, 63, 1, "click", 360), (5, 63, 1, "signup", 360), (6, 63, 1, "click", None),
        (7, None, 1, "error", 36), (8, 120, 1, "view", 360), (9, 122, 1, "signup", 360),
    ],
}


def value(x, kind):
    return f"{'null' if x is None else x}::{kind}"


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    made = {}
    for name, rows in TABLES.items():
        where, con = tmp_path_factory.mktemp("odd-rows"), duckdb.connect()
        rows = ", ".join(f"({value(i, 'bigint')}, timestamp '2024-01-01' + interval 1 hour * {value(h, 'int')}, {u}::bigint, '{k}', {value(v, 'double')}, '{{}}')" for i, h, u, k, v in rows)
        con.execute(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{where}/events.parquet' (format parquet)")
        con.execute(f"create view events as select * from '{where}/events.parquet'")
        made[name] = str(where), con
    return made


def check(spark, made, name):
    where, con = made
    got = plain(registry.QUERIES[name](spark, where).toPandas())
    pd.testing.assert_frame_equal(got, plain(con.execute(registry.ORACLE_SQL[name]).df()), check_dtype=False)


@pytest.mark.parametrize("rows", TABLES)
def test_chunk_class_units(spark, events, rows):
    check(spark, events[rows], "chunk_class_units")


@pytest.mark.parametrize("rows", TABLES)
def test_class_scores(spark, events, rows):
    check(spark, events[rows], "class_scores")


@pytest.mark.parametrize("rows", TABLES)
def test_edge_error_types(spark, events, rows):
    check(spark, events[rows], "edge_error_types")


@pytest.mark.parametrize("rows", TABLES)
def test_marked_units(spark, events, rows):
    check(spark, events[rows], "marked_units")
