"""Signal thresholds rated by backtests: the curve over a grid, the choice on it and whether both halves of the rows agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions.portable import spark as in_spark
from tidelane.operators import backtest, recurrences

#: Candidate thresholds in percent.
GRID = tuple(range(30, 86, 2))
#: Rows that a symbol needs for its halves to be compared, and how far apart their choices may lie (in percent points).
LEAST_ROWS, TOLERANCE = 400, 4
#: Which row of a curve is the choice: the best objective of those with {least} trades (ties to the lower threshold), a row of these without any
#: objective, else the most active threshold. Objectives are compared to nine decimals.
CHOICE = """CASE WHEN n_trades < {least} THEN 2 WHEN objective IS NULL THEN 1 ELSE 0 END, CASE WHEN n_trades >= {least} THEN round(objective, 9) END DESC NULLS LAST,
    CASE WHEN n_trades < {least} THEN n_trades END DESC NULLS LAST, percent"""
#: The choice {chosen} with the curve {cu} of the halves, of at least a third as many trades, beside it; {sizes} counts rows by symbol.
STABILITY = """SELECT ch.symbol, ch.percent / CAST(100 AS DOUBLE) AS threshold, ch.n_trades, ch.objective, ch.n_trades >= {least} AS enough_trades, a.percent / CAST(100 AS DOUBLE) AS first_half, b.percent / CAST(100 AS DOUBLE) AS second_half, s.n >= {rows} AS compared,
    CASE WHEN s.n >= {rows} THEN coalesce(abs(a.percent - b.percent) <= {tolerance}, false) END AS agrees FROM {chosen} ch JOIN {sizes} s ON s.symbol = ch.symbol
    LEFT JOIN {halves} a ON a.symbol = ch.symbol AND a.part = 'first' AND s.n >= {rows} LEFT JOIN {halves} b ON b.symbol = ch.symbol AND b.part = 'second' AND s.n >= {rows}"""


def choice(least: int) -> str:
    """The ORDER BY that brings the choice to the front."""
    return CHOICE.replace("{least}", str(least))


def stability(least: int) -> str:
    return STABILITY.replace("{least}", str(least)).replace("{rows}", str(LEAST_ROWS)).replace("{tolerance}", str(TOLERANCE))


def curve(bars: DataFrame, grid: tuple[int, ...] = GRID, parts: bool = False, **rules) -> DataFrame:
    """symbol, part, percent and the measures of ``backtest`` for each threshold of ``grid``; ``rules`` go to ``recurrences.trades``.

    Takes symbol, h, open, close, prob. Part is ``all``; with ``parts`` also ``first`` and ``second``, each half backtested by itself. Bars are repeated
    once for each threshold, a bounded number, and each (symbol, part, threshold) is a series of its own, so tasks stay as large as one backtest.
    A symbol without trades has its row, with 0 trades; an empty table gives none, nor do rows without a symbol.
    """
    spark = bars.sparkSession
    rows = bars.select("symbol", "h", "open", "close", "prob").where("symbol IS NOT NULL")
    halves = rows.selectExpr("*", "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY h) <= floor(count(*) OVER (PARTITION BY symbol) / 2) THEN 'first' ELSE 'second' END AS half")
    part = F.explode(F.array(F.lit("all"), "half")) if parts else F.lit("all")
    tried = halves.withColumn("part", part).withColumn("percent", F.explode(F.array(*map(F.lit, grid))))
    tried = tried.withColumn("symbol", F.concat_ws("@", "symbol", "part", "percent")).withColumn("threshold", F.col("percent") / 100)
    ledger = backtest.priced(recurrences.trades(tried, threshold="threshold", **rules))
    e = backtest.equity(tried, ledger)
    c, t = spark.sql(in_spark(backtest.constants(backtest.CURVE)), e=e), spark.sql(in_spark(backtest.LEDGER), t=ledger)
    report = spark.sql(in_spark(backtest.constants(backtest.REPORT)), c=c, l=t).withColumnRenamed("symbol", "series")
    pieces = [F.regexp_extract("series", "(?s)^(.*)@([a-z]+)@([0-9]+)$", k) for k in (1, 2, 3)]
    return report.select(pieces[0].alias("symbol"), pieces[1].alias("part"), pieces[2].cast("int").alias("percent"), *(n for n in report.columns if n != "series"))


def select(bars: DataFrame, grid: tuple[int, ...] = GRID, objective: str = "excess_vs_buy_hold", least: int = 30, **rules) -> DataFrame:
    """symbol, threshold, n_trades, objective, enough_trades, first_half, second_half, compared and agrees: the threshold of each symbol by ``CHOICE``.

    Pass validation rows only. Each half has a choice of its own among thresholds of at least ``max(10, least // 3)`` trades and an objective, null if there is
    none; halves are compared from ``LEAST_ROWS`` rows on (agrees is null below), and agree if their choices are within ``TOLERANCE``.
    """
    spark = bars.sparkSession
    cu = curve(bars, grid, parts=True, **rules).withColumn("objective", F.col(objective)).select("symbol", "part", "percent", "n_trades", "objective")
    best = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY {order}) AS place FROM {cu} WHERE {where}) q WHERE place = 1"
    chosen = spark.sql(best.replace("{order}", choice(least)).replace("{where}", "part = 'all'"), cu=cu)
    few = max(10, least // 3)
    halves = spark.sql(best.replace("{order}", choice(few)).replace("{where}", f"part <> 'all' AND n_trades >= {few} AND objective IS NOT NULL"), cu=cu)
    return spark.sql(stability(least), chosen=chosen, halves=halves, sizes=bars.groupBy("symbol").agg(F.count("*").alias("n")))
