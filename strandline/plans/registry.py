"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("behaviour", "serving", "catalogue", "vectors", "quality", "storage", "interfaces")

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"{f.__name__} is registered twice")
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _load() -> None:
    """The modules register their queries when they are imported."""
    for name in MODULES:
        importlib.import_module(f"strandline.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
