"""Mark-to-market equity of a trade ledger and the measures of a backtest, as window and aggregate plans over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.asof import asof_join

#: Measures of the equity curve {e} by symbol; periods a year and the risk-free rate of a bar are {periods} and {rf}.
CURVE = """SELECT symbol, count(*) AS n_bars, max_by(equity, h) AS final_capital, max_by(close, h) / min_by(close, h) AS held, max((peak - equity) / peak) AS max_drawdown,
    stddev_samp(r) AS deviation, avg(r - {rf}) AS excess, sqrt(avg(CASE WHEN r < {rf} THEN (r - {rf}) * (r - {rf}) END)) AS downside, count(CASE WHEN r < {rf} THEN 1 END) AS n_down,
    avg(CASE WHEN in_position THEN 1.0 ELSE 0.0 END) AS time_in_market
    FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY h) - 1 AS r, greatest({capital}, max(equity) OVER (PARTITION BY symbol ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM {e}) q GROUP BY symbol"""
#: Measures of the priced ledger {t} by symbol.
LEDGER = """SELECT symbol, count(*) AS n_trades, count(CASE WHEN early THEN 1 END) AS n_early, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(fees) AS fees_paid, sum(slippage) AS slippage_paid,
    coalesce(sum(CASE WHEN net > 0 THEN pnl END), 0) AS gross_profit, coalesce(-sum(CASE WHEN net < 0 THEN pnl END), 0) AS gross_loss, avg(CASE WHEN net > 0 THEN net END) / nullif(-avg(CASE WHEN net < 0 THEN net END), 0) AS payoff_ratio,
    avg(net) AS avg_trade, PCT_[net; 0.5] AS median_trade, max(net) AS best_trade, min(net) AS worst_trade, avg(bars) AS avg_hold FROM {t} GROUP BY symbol"""
#: Both together: {c} and {l} are the results of CURVE and LEDGER.
REPORT = """SELECT symbol, {capital} AS initial_capital, final_capital, final_capital - {capital} AS total_pnl, final_capital / {capital} - 1 AS total_return, cagr, max_drawdown, deviation * sqrt({periods}) AS volatility,
    excess / nullif(deviation, 0) * sqrt({periods}) AS sharpe, CASE WHEN n_down > 1 THEN excess / nullif(downside, 0) * sqrt({periods}) END AS sortino, CASE WHEN max_drawdown > 0 THEN cagr / max_drawdown END AS calmar,
    held - 1 AS buy_hold_return, held * {kept} - 1 AS buy_hold_net, final_capital / {capital} - held * {kept} AS excess_vs_buy_hold, time_in_market, n_bars, coalesce(n_trades, 0) AS n_trades, coalesce(n_early, 0) AS n_early, win_rate,
    coalesce(fees_paid, 0) AS fees_paid, coalesce(slippage_paid, 0) AS slippage_paid, coalesce(fees_paid + slippage_paid, 0) AS costs_paid, coalesce((fees_paid + slippage_paid) / greatest(final_capital, 1e-9) * 10000, 0) AS costs_bps,
    coalesce(gross_profit, 0) AS gross_profit, coalesce(gross_loss, 0) AS gross_loss, CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss END AS profit_factor, payoff_ratio, avg_trade, median_trade, best_trade, worst_trade, avg_hold
    FROM (SELECT c.*, pow(final_capital / {capital}, {periods} / CAST(n_bars AS DOUBLE)) - 1 AS cagr, l.n_trades, l.n_early, l.win_rate, l.fees_paid, l.slippage_paid, l.gross_profit, l.gross_loss, l.payoff_ratio, l.avg_trade, l.median_trade, l.best_trade, l.worst_trade, l.avg_hold FROM {c} c LEFT JOIN {l} l ON c.symbol = l.symbol) z"""


def priced(ledger: DataFrame, capital: float = 10_000.0, cost: float = 0.001) -> DataFrame:
    """The ledger with units, before and after (capital around the trade), fees, slippage and pnl. All capital goes into each trade, which pays ``cost`` at both ends."""
    growth = F.col("exit") * (1 - cost) / (F.col("entry") * (1 + cost))
    earlier = Window.partitionBy("symbol").orderBy("entry_h").rowsBetween(Window.unboundedPreceding, -1)
    t = ledger.withColumn("before", F.lit(capital) * F.exp(F.coalesce(F.sum(F.log(growth)).over(earlier), F.lit(0.0)))).withColumn("after", F.col("before") * growth)
    units = F.col("before") / (F.col("entry") * (1 + cost))
    return (
        t.withColumn("units", units)
        .withColumn("fees", F.col("units") * (F.col("entry") + F.col("exit")) * cost)
        .withColumn("slippage", F.col("units") * (F.col("entry") - F.col("raw_entry") + F.col("raw_exit") - F.col("exit")))
        .withColumn("pnl", F.col("after") - F.col("before"))
    )


def equity(bars: DataFrame, trades: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """symbol, h, close, equity and in_position for each bar: units at the close while a trade of ``priced`` is held (its last bar too), else cash. Without trades it is the capital."""
    at = asof_join(bars.select("symbol", "h", "close"), trades, ["symbol"], "h", "entry_h", ["exit_h", "units", "after"])
    held = F.coalesce(F.col("h") <= F.col("exit_h"), F.lit(False))
    return at.select("symbol", "h", "close", F.when(held, F.col("units") * F.col("close")).otherwise(F.coalesce("after", F.lit(capital))).alias("equity"), held.alias("in_position"))


def constants(text: str, capital: float = 10_000.0, periods: int = 8_760, risk_free: float = 0.0, cost: float = 0.001, slip: float = 0.0005) -> str:
    """The SQL with its constants; tables {e}, {t}, {c} and {l} stay."""
    rf, kept = (1 + risk_free) ** (1 / periods) - 1, ((1 - cost) * (1 - slip)) ** 2
    for name, value in (("capital", capital), ("periods", periods), ("rf", rf), ("kept", kept)):
        text = text.replace("{" + name + "}", f"CAST({value!r} AS DOUBLE)")
    return text
