"""All queries of the analytics library, and their SQL counterparts.

A query is a function ``(spark, sf_dir) -> DataFrame``, registered with the equivalent SQL if SQL can
express it. Column names agree on both sides; fractions are rounded on both sides.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("scans", "relational", "aggregates", "windows", "scalars", "statistics", "survival", "resampling", "models", "decisions", "audits", "streams", "ingestion", "crosschecks", "nested", "permutations", "timeframes")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql.strip()
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tarn.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
