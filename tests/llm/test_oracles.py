"""The corpus queries that SQL can express, against that SQL."""

from __future__ import annotations

import duckdb
import pytest

from ledgerlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = connection.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
