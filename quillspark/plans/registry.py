"""Query registry.

Each registered query is ``fn(spark, sf_dir) -> DataFrame``. ``sql`` is the
independent DuckDB oracle (same column names); ``None`` means the result is
not SQL-expressible and only row counts are checked by the driver.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MODULES = [
    "quillspark.plans.listing_queries",
    "quillspark.plans.source_queries",
    "quillspark.plans.projection_queries",
    "quillspark.plans.filter_queries",
    "quillspark.plans.join_queries",
    "quillspark.plans.aggregate_queries",
    "quillspark.plans.window_queries",
    "quillspark.plans.sort_queries",
    "quillspark.plans.set_queries",
    "quillspark.plans.scalar_queries",
    "quillspark.plans.search_queries",
    "quillspark.plans.prep_queries",
    "quillspark.plans.streaming_queries",
]


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != m:
                raise


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLE)
