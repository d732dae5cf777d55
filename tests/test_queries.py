"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerlens import queries as own
from ledgerlens.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows_of(pdf):
    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.7g}" if math.isfinite(v) else str(v)
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(own.oracles()))
def test_query_equals_sql(spark, duck, name):
    got, want = own.queries()[name](spark, SF).toPandas(), duck.sql(own.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numeric = [c for c in got.columns if got[c].dtype != want[c].dtype and got[c].dtype.kind in "if"]
    for c in numeric:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracles())))
def test_other_queries_have_rows(spark, name):
    assert own.queries()[name](spark, SF).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 10
    assert set(contract.oracle_sql()) <= set(contract.queries())
