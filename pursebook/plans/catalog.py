"""Registry of the ledger queries and of the SQL that each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pursebook.plans import insight_queries, insight_sql, intake_queries, intake_sql, ledger_queries, ledger_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return ledger_queries.QUERIES | intake_queries.QUERIES | insight_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return ledger_sql.ORACLE_SQL | intake_sql.ORACLE_SQL | insight_sql.ORACLE_SQL
