"""All queries of the core, by name, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galley.plans import general_queries, html_queries, output_queries, routing_queries, section_queries, state_queries, unit_queries

_MODULES = (general_queries, section_queries, html_queries, state_queries, routing_queries, output_queries, unit_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return html_queries.entry_audit(spark, root)
