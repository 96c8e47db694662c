"""All registered queries outside the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lucerna.plans import package_queries, package_sql, table_queries, table_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = table_queries.QUERIES | package_queries.QUERIES
ORACLE: dict[str, str] = table_sql.ORACLE | package_sql.ORACLE
