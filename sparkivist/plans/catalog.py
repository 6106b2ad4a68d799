"""Names of the core's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkivist.plans import oracles, queries_evaluation, queries_records, queries_retrieval, queries_state


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**queries_retrieval.QUERIES, **queries_records.QUERIES, **queries_evaluation.QUERIES, **queries_state.QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
