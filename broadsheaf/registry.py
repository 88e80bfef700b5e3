"""Queries of the engine with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return wrap


def _load() -> None:
    from . import catalogue  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
