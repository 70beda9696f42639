"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorestack.operators import incremental, orphans
from lorestack.plans import capture, extract, graph, lifecycle, recall, retrieval, store, text

MODULES = (orphans, incremental, text, store, graph, retrieval, extract, capture, lifecycle, recall)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
