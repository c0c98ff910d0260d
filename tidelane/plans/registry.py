"""Queries by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelane.functions.portable import duckdb as in_duckdb
from tidelane.functions.portable import spark as in_spark
from tidelane.plans import operators
from tidelane.plans.catalog import PLANS
from tidelane.sources.candles import table


def run_plan(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in ("events", "orders") if "{" + t + "}" in sql}
    return spark.sql(in_spark(sql), **used)


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_plan(spark, sf_dir, sql)


def oracle(sql: str) -> str:
    return in_duckdb(sql).replace("{events}", "events").replace("{orders}", "orders")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(sql) for name, sql in PLANS.items()} | operators.QUERIES
ORACLE_SQL: dict[str, str] = {name: oracle(sql) for name, sql in PLANS.items()} | operators.ORACLE_SQL
