"""Paged candle endpoints: a client that any transport drives, and parsing of its rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a raw row, in order.
FIELDS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_volume", "taker_buy_quote_volume", "spare"]


def pages(transport: Callable[[int, int], list], start: int, step: int, end: int | None = None, limit: int = 1000, tries: int = 5, sleep: Callable[[float], None] = time.sleep, wait: float = 0.5) -> Iterator[list]:
    """Pages from ``start`` on: the cursor goes one step past the last row; a short page, the end, or a cursor that stands still stops it. Failures are tried again after a random wait that doubles."""
    cursor = start
    while end is None or cursor <= end:
        page = _tried(lambda at=cursor: transport(at, limit), tries, sleep, wait)
        page = [r for r in page if end is None or r[0] <= end]
        if not page:
            return
        yield page
        following = page[-1][0] + step
        if len(page) < limit or following <= cursor:
            return
        cursor = following


def _tried(call: Callable[[], list], tries: int, sleep: Callable[[float], None], wait: float) -> list:
    for k in range(tries):
        try:
            return call()
        except (ConnectionError, TimeoutError, OSError):
            if k == tries - 1:
                raise
            sleep(random.uniform(0, wait * 2**k))
    raise AssertionError


class Bucket:
    """Token bucket: ``take(n)`` returns the seconds to wait before n requests are allowed."""

    def __init__(self, rate: float, size: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.size, self.level, self.clock = rate, size, size, clock
        self.at = clock()

    def take(self, n: float = 1) -> float:
        now = self.clock()
        self.level = min(self.size, self.level + (now - self.at) * self.rate) - n
        self.at = now
        return max(0.0, -self.level / self.rate)


def parse(spark: SparkSession, rows: list) -> DataFrame:
    """Raw rows as typed candles; what cannot be read becomes null. Empty input gives an empty table of the same columns."""
    raw = spark.createDataFrame([[None if x is None else str(x) for x in r] for r in rows], ", ".join(f"{f} string" for f in FIELDS))
    kinds = {"open_time": "bigint", "close_time": "bigint", "trades": "bigint"}
    typed = raw.select(*(F.expr(f"try_cast({f} AS {kinds.get(f, 'double')})").alias(f) for f in FIELDS[:-1]))
    return typed.withColumn("timestamp", F.timestamp_millis("open_time"))
