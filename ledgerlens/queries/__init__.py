"""The registered queries over the test tables, each with the same question in SQL where that can be asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.queries import graphs, ingest, relational, retrieval, streams, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (relational, texts, retrieval, graphs, ingest, streams)


def queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
