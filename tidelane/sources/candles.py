"""Candles from event and order tables, and plain table reads.

A candle table has symbol, h (number of the hour or day since 1970), open, high, low, close, volume,
quote_volume, trades and the taker's buys. First and last go by event time, then by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.functions.portable import spark as in_spark

_VALUES = """
    min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close,
    sum(value) AS volume, sum(value * value) AS quote_volume, count(*) AS trades,
    sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0.0 END) AS taker_buy_volume,
    sum(CASE WHEN user_id % 2 = 0 THEN value * value ELSE 0.0 END) AS taker_buy_quote_volume"""

HOURLY = f"SELECT event_type AS symbol, CAST(floor(EPOCH_[ts] / 3600) AS BIGINT) AS h, {_VALUES} FROM {{events}} GROUP BY 1, 2"
HOURLY_ALL = f"SELECT 'ALL' AS symbol, CAST(floor(EPOCH_[ts] / 3600) AS BIGINT) AS h, {_VALUES} FROM {{events}} GROUP BY 1, 2"
DAILY = """
    SELECT 'orders' AS symbol, CAST(floor(EPOCH_[o_orderdate] / 86400) AS BIGINT) AS h,
        min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
        sum(o_totalprice) AS volume, sum(o_totalprice * o_totalprice) AS quote_volume, count(*) AS trades,
        sum(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE 0.0 END) AS taker_buy_volume,
        sum(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice * o_totalprice ELSE 0.0 END) AS taker_buy_quote_volume
    FROM {orders} GROUP BY 1, 2"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(events: DataFrame, together: bool = False) -> DataFrame:
    """Hourly candles by event type, or of all events as symbol ALL. Partial aggregation comes before the shuffle, so that a hot type is a few rows a task."""
    return events.sparkSession.sql(in_spark(HOURLY_ALL if together else HOURLY), events=events)


def daily(orders: DataFrame) -> DataFrame:
    return orders.sparkSession.sql(in_spark(DAILY), orders=orders)
