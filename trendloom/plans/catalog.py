"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the stock tables (or views Spark derives from them, see
``trendloom.sources.derived``) over their whole extent.  The matching
DuckDB SQL for each name lives in ``trendloom.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # importing the modules fills QUERIES
    from trendloom.plans import q_detect, q_graph, q_io, q_pages, q_status, q_terms  # noqa: F401
    return dict(QUERIES)
