"""All queries of the engine's operators by name, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_analytics, queries_backtest, queries_market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_market, queries_backtest, queries_analytics):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

FLAGSHIP = "resample_15m"
