"""Every named query of the graph engine with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans import graph_queries, service_queries, source_queries  # noqa: F401 - the last two add their queries to the first's

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(graph_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(graph_queries.ORACLES)
