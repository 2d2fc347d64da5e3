"""All queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Tables, with_bindings

_queries: dict[str, Callable[[Tables], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with the SQL that DuckDB answers alike."""

    def add(function: Callable[[Tables], DataFrame]):
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    from .plans import digests, ingest, listing, payloads, queue, runs, scoring, sources, stats, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: with_bindings(s) for n, s in _sql.items()}
