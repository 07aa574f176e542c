"""Every registered building query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from rooftide.plans.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ROOFTIDE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in ("customer", "orders", "lineitem", "nation", "part"):
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    found = QUERIES[name](spark, SF_DIR)
    rows = found.collect()
    assert rows
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert [want.columns[i] for i in order] == sorted(found.columns)
        theirs = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
        assert sorted(repr(tuple(r[c] for c in sorted(found.columns))) for r in rows) == theirs
