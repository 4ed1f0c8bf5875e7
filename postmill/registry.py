"""All registered queries of the reference operators with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.plans import (
    collect, functions_queries, label_queries, mapping_queries, more_queries, recommend, relational, resolution_queries, small_queries, source_queries, streaming_queries, validation_queries, workflow_queries,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Key of the flagship query.
FLAGSHIP = "K24_top7_per_user"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


for module in (functions_queries, recommend, collect, relational, resolution_queries, small_queries, source_queries, streaming_queries, more_queries, validation_queries, label_queries, workflow_queries, mapping_queries):
    module.register(_add)
