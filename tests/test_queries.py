"""Every query with an SQL twin gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanwright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        frame[c] = frame[c].map(
            lambda x: "NULL" if x is None or x is pd.NA or x != x else f"{float(x):.6f}" if isinstance(x, (float, np.floating)) else str(x)
        )
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, connection, name):
    got = plain(registry.QUERIES[name](spark, SF).toPandas())
    want = plain(connection.execute(registry.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_the_rest_runs(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SF).count() > 0, name
