"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import conversations, corpus, retrieval, service, streams

AREAS = (corpus, retrieval, conversations, service, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for area in AREAS for name, f in area.plans.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for area in AREAS for name, sql in area.plans.sql.items()}
