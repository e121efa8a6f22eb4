"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quern.sources.payloads import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; without SQL where none can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


T = TypeVar("T")
_STORES: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], T], opened: Callable[[str], T]) -> T:
    """What ``build`` stores under a path of the shared folder, once for these tables and this application; then what ``opened`` reads there."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key in _STORES:
        try:
            return opened(_STORES[key])
        except AnalysisException:  # the folder was cleared
            pass
    path = scratch(spark, name)
    out = build(path)
    _STORES[key] = path
    return out
