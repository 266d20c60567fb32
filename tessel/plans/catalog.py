"""All queries of the core, gathered from their modules."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.plans import context_queries, guideline_queries, link_queries, metric_queries, stream_queries, table_queries, text_queries, training_queries

MODULES = [training_queries, table_queries, link_queries, metric_queries, text_queries, guideline_queries, context_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
