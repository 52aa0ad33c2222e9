"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteloom.plans import ingest_queries, note_queries, rule_queries, search_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search_queries.QUERIES, **note_queries.QUERIES, **ingest_queries.QUERIES, **rule_queries.QUERIES}
ORACLES: dict[str, str] = {**search_queries.ORACLES, **note_queries.ORACLES, **ingest_queries.ORACLES, **rule_queries.ORACLES}
