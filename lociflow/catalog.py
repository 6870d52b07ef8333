"""All queries of the library by name, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import expression_queries, filter_queries, gene_queries, group_queries, interval_queries, search_queries, sequence_queries, series_queries, table_queries

MODULES = (interval_queries, gene_queries, table_queries, sequence_queries, series_queries, expression_queries, search_queries, filter_queries, group_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
