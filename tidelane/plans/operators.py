"""Queries that run DataFrame operators, with SQL written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.portable import digits
from tidelane.functions.portable import duckdb as in_duckdb
from tidelane.functions.portable import spark as in_spark
from tidelane.operators import asof, backtest, bootstrap, classifiers, features, models, recurrences, thresholds
from tidelane.plans.catalog import HOURS, PREDICTIONS
from tidelane.sources.candles import DAILY, HOURLY, HOURLY_ALL, daily, hourly, table
from tidelane.streaming.candles import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = in_duckdb(sql).replace("{events}", "events").replace("{orders}", "orders")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


#: Whole numbers among the features.
WHOLE = {"funding_streak", "days_since_change", "regime", "regime_change", "above_ma30"}


def _shown(name: str) -> str:
    return name if name in WHOLE else f"{digits(name)} AS {name}"


def _rounded(names: list[str]) -> str:
    return ", ".join(map(_shown, names))


# --- feature groups ------------------------------------------------------------------------------------------
def _group(name: str, source: Callable[[SparkSession, str], DataFrame], source_sql: str, layers: features.Layers, hide: tuple[str, ...] = (), with_source: tuple[str, ...] = ()) -> None:
    columns = [*with_source, *features.names(layers, *hide)]
    _add(name, lambda spark, sf: features.add(source(spark, sf), [{n: in_spark(e) for n, e in layer.items()} for layer in layers]).selectExpr("symbol", "h", *map(_shown, columns)), f"WITH {features.sql(source_sql, layers)} SELECT symbol, h, {_rounded(columns)} FROM f")


_group("features_technical", lambda s, d: hourly(_events(s, d)), HOURLY, features.technical(), hide=("log_return", "bb_std", "true_range"))
_group("features_technical_all", lambda s, d: hourly(_events(s, d), together=True), HOURLY_ALL, features.technical(), hide=("log_return", "bb_std", "true_range"))
_group("features_technical_daily", lambda s, d: daily(table(s, d, "orders")), DAILY, features.technical(sma=(10, 20, 50, 100, 200), bars_a_year=365), hide=("log_return", "bb_std", "true_range"))
_group("features_microstructure", lambda s, d: hourly(_events(s, d)), HOURLY, features.microstructure(), hide=("sell_volume", "price_step"), with_source=("taker_buy_volume", "taker_buy_quote_volume"))

# spot is purchases, futures are views, funding is the last click of eight hours, known at their end
_FUNDING = "SELECT CAST(floor(h / 8) AS BIGINT) * 8 + 8 AS known, (max_by(close, h) - 50) / 1000 AS funding_rate FROM c WHERE symbol = 'click' GROUP BY 1"
_SPOT = "SELECT s.symbol, s.h, s.close, s.volume, s.trades, v.close AS futures_price, v.volume AS futures_volume, v.trades AS futures_trades, v.taker_buy_volume AS futures_taker_buy FROM c s LEFT JOIN c v ON v.symbol = 'view' AND v.h = s.h WHERE s.symbol = 'purchase'"


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot candles with futures of the hour and the newest known funding rate (at most 24 hours old)."""
    c = hourly(_events(spark, sf_dir))
    spot = spark.sql(in_spark(_SPOT.replace("FROM c s", "FROM {c} s").replace("JOIN c v", "JOIN {c} v")), c=c)
    funding = spark.sql(in_spark(_FUNDING.replace("FROM c", "FROM {c}")), c=c).withColumn("symbol", F.lit("purchase"))
    return asof.asof_join(spot, funding, ["symbol"], "h", "known", ["funding_rate"], max_age=24)


_ALIGNED = f"SELECT t.*, CASE WHEN t.h - f.known <= 24 THEN f.funding_rate END AS funding_rate FROM (WITH {HOURS} {_SPOT}) t ASOF LEFT JOIN (WITH {HOURS} {_FUNDING}) f ON t.h >= f.known"
_group("features_derivatives", aligned, _ALIGNED, features.derivatives(), hide=("funding_positive", "funding_sign", "streak_break", "streak_run"), with_source=("funding_rate", "futures_price", "futures_volume"))

_INDEX = "SELECT 'signup' AS symbol, CAST(floor(h / 24) AS BIGINT) AS h, avg(close) AS value FROM c WHERE symbol = 'signup' GROUP BY 2"
_group("features_sentiment", lambda s, d: s.sql(in_spark(_INDEX.replace("FROM c", "FROM {c}")), c=hourly(_events(s, d))), f"WITH {HOURS} {_INDEX}", features.sentiment(long=10, least=5), hide=("moved", "quiet_run"), with_source=("value",))

# a day's index values are known from the day's end on, for three days
_DAILY_INDEX = features.sentiment(long=10, least=5)
_INDEX_SHOWN = ["value", "mean_7", "regime"]


def _hourly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hourly(_events(spark, sf_dir))
    days = features.add(spark.sql(in_spark(_INDEX.replace("FROM c", "FROM {c}")), c=c), [{n: in_spark(e) for n, e in layer.items()} for layer in _DAILY_INDEX])
    known = days.select(F.lit("purchase").alias("symbol"), (F.col("h") * 24 + 24).alias("known"), *_INDEX_SHOWN)
    return asof.asof_join(c.where("symbol = 'purchase'").select("symbol", "h"), known, ["symbol"], "h", "known", _INDEX_SHOWN, max_age=72).selectExpr("symbol", "h", *map(_shown, _INDEX_SHOWN))


_add("features_sentiment_hourly", _hourly_index, f"SELECT t.symbol, t.h, {', '.join(f'CASE WHEN t.h - f.h * 24 - 24 <= 72 THEN {n if n in WHOLE else digits(n)} END AS {n}' for n in _INDEX_SHOWN)} FROM (SELECT symbol, h FROM ({HOURLY}) c WHERE symbol = 'purchase') t ASOF LEFT JOIN (WITH {features.sql(f'WITH {HOURS} {_INDEX}', _DAILY_INDEX)} SELECT *, h * 24 + 24 AS known FROM f) f ON t.h >= f.known")

_BAR = "SELECT symbol, CAST(floor(h / {w}) AS BIGINT) * {w} + {w} AS done, max_by(close, h) AS {c}, sum(volume) AS {v} FROM c GROUP BY 1, 2"


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles with the last completed bars of 4 hours and of a day."""
    c = hourly(_events(spark, sf_dir))
    out = c
    for w, close, volume in ((4, "c4", "v4"), (24, "c1", "v1")):
        bars = spark.sql(in_spark(_BAR.format(w=w, c=close, v=volume).replace("FROM c", "FROM {c}")), c=c)
        out = asof.asof_join(out, bars, ["symbol"], "h", "done", [close, volume], slice_width=168).drop("source_time")
    return out


_COMPLETED = f"SELECT c.symbol, c.h, c.close, c4, v4, c1, v1 FROM ({HOURLY}) c ASOF LEFT JOIN (WITH {HOURS} {_BAR.format(w=4, c='c4', v='v4')}) a ON c.symbol = a.symbol AND c.h >= a.done ASOF LEFT JOIN (WITH {HOURS} {_BAR.format(w=24, c='c1', v='v1')}) b ON c.symbol = b.symbol AND c.h >= b.done"
_group("features_context", completed, _COMPLETED, features.context(), hide=("ctx_vol_10",))
_add("asof_completed_bars", lambda s, d: completed(s, d).selectExpr("symbol", "h", "round(c4, 6) AS c4", "round(v4, 6) AS v4", "round(c1, 6) AS c1", "round(v1, 6) AS v1"), f"SELECT symbol, h, {_rounded(['c4', 'v4', 'c1', 'v1'])} FROM ({_COMPLETED}) t")
_add("asof_operator", lambda s, d: aligned(s, d).selectExpr("symbol", "h", "round(funding_rate, 6) AS funding_rate"), f"SELECT symbol, h, round(funding_rate, 6) AS funding_rate FROM ({_ALIGNED}) t")
_add("asof_operator_audit", lambda s, d: asof.audit(aligned(s, d), "h", ["funding_rate"], 24), "SELECT 0::BIGINT AS n_unsourced, 0::BIGINT AS n_ahead, 0::BIGINT AS n_stale")


# --- recurrences ---------------------------------------------------------------------------------------------
_ORDERED = f"{HOURS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY h) AS i, close - lag(close) OVER (PARTITION BY symbol ORDER BY h) AS step, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY h)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY h))) AS tr FROM c)"
_OSCILLATORS = f"""WITH RECURSIVE {_ORDERED}, e AS (
    SELECT symbol, h, i, close AS f, close AS s, CAST(0 AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, tr AS atr FROM n WHERE i = 1
    UNION ALL SELECT n.symbol, n.h, n.i, e.f + 2 / 13e0 * (n.close - e.f), e.s + 2 / 27e0 * (n.close - e.s),
        e.g + 0.2 * ((e.f + 2 / 13e0 * (n.close - e.f)) - (e.s + 2 / 27e0 * (n.close - e.s)) - e.g),
        CASE WHEN e.up IS NULL THEN greatest(n.step, 0) ELSE e.up + (greatest(n.step, 0) - e.up) / 14 END,
        CASE WHEN e.down IS NULL THEN greatest(-n.step, 0) ELSE e.down + (greatest(-n.step, 0) - e.down) / 14 END, e.atr + (n.tr - e.atr) / 14
    FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
    SELECT symbol, h, round(f, 6) AS ema_fast, round(s, 6) AS ema_slow, round(f - s, 6) AS macd, round(g, 6) AS macd_signal, round(f - s - g, 6) AS macd_histogram, round(CASE WHEN up + down > 1e-12 THEN 100 * up / (up + down) END, 6) AS rsi, round(atr, 6) AS atr, round(CASE WHEN abs(price) > 1e-12 THEN 100 * atr / price END, 6) AS atr_percent FROM e JOIN (SELECT symbol AS of_symbol, i AS place, close AS price FROM n) q ON symbol = of_symbol AND i = place"""
_add("oscillators_ema_macd_rsi_atr", lambda s, d: recurrences.oscillators(hourly(_events(s, d))).selectExpr("symbol", "h", *(f"round({c}, 6) AS {c}" for c in ("ema_fast", "ema_slow", "macd", "macd_signal", "macd_histogram", "rsi", "atr", "atr_percent"))), _OSCILLATORS)
_GREEDY = "t AS (SELECT symbol, min(h) AS h FROM sig GROUP BY symbol UNION ALL SELECT t.symbol, (SELECT min(h) FROM sig WHERE sig.symbol = t.symbol AND sig.h >= t.h + 6) FROM t WHERE (SELECT min(h) FROM sig WHERE sig.symbol = t.symbol AND sig.h >= t.h + 6) IS NOT NULL)"
_add("entries_not_overlapping", lambda s, d: recurrences.entries(hourly(_events(s, d)).where("close > 60"), 6), f"WITH RECURSIVE {HOURS}, sig AS (SELECT symbol, h FROM c WHERE close > 60), {_GREEDY} SELECT symbol, h FROM t")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with candles: symbol, h, open, close, y, mom, prob, label, r1."""
    p = spark.sql(in_spark(f"WITH {HOURS}, {PREDICTIONS} SELECT v.*, c.open, c.close FROM v JOIN c ON v.symbol = c.symbol AND v.h = c.h").replace("{events}", "{e}"), e=_events(spark, sf_dir))
    return p


def _ledger(exit_below: str | None = None) -> str:
    """The ledger as SQL: each signal's exit and the next signal after it first, then the chain of those taken."""
    low = "CAST(NULL AS BIGINT) AS low FROM g"
    if exit_below:
        low = f"min(e.i) AS low FROM g LEFT JOIN g e ON e.symbol = g.symbol AND e.i > g.i + 1 AND e.i <= g.i + 6 AND e.prob < {exit_below}"
    return f"""{HOURS}, {PREDICTIONS}, g AS (SELECT v.symbol, v.h, v.prob, c.open, c.close, row_number() OVER (PARTITION BY v.symbol ORDER BY v.h) AS i, count(*) OVER (PARTITION BY v.symbol) AS n FROM v JOIN c ON v.symbol = c.symbol AND v.h = c.h),
    sx AS (SELECT g.symbol, g.i, least(g.i + 6, g.n) AS latest, {low} WHERE g.prob >= 0.6 AND g.i < g.n GROUP BY ALL),
    sig AS (SELECT symbol, i, coalesce(low, latest) AS x, low IS NOT NULL AS early FROM sx),
    nx AS (SELECT g.symbol, g.i, min(s.i) OVER (PARTITION BY g.symbol ORDER BY g.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM g LEFT JOIN sig s ON s.symbol = g.symbol AND s.i = g.i),
    follow AS (SELECT a.symbol, a.i, b.after FROM sig a JOIN nx b ON b.symbol = a.symbol AND b.i = a.x WHERE b.after IS NOT NULL),
    t AS (SELECT symbol, min(i) AS i FROM sig GROUP BY symbol UNION ALL SELECT f.symbol, f.after FROM t JOIN follow f ON f.symbol = t.symbol AND f.i = t.i),
    tr AS (SELECT t.symbol, a.h AS entry_h, b.h AS exit_h, a.open AS raw_entry, b.close AS raw_exit, a.open * 1.0005 AS entry, b.close * 0.9995 AS exit_, b.i - a.i + 1 AS bars, s.early FROM t JOIN sig s ON s.symbol = t.symbol AND s.i = t.i JOIN g a ON a.symbol = t.symbol AND a.i = t.i + 1 JOIN g b ON b.symbol = t.symbol AND b.i = s.x),
    tn AS (SELECT *, raw_exit / raw_entry - 1 AS gross, exit_ / entry * 0.999 * 0.999 - 1 AS net FROM tr)"""


_TRADE = "round(raw_entry, 6) AS raw_entry, round(raw_exit, 6) AS raw_exit, round(gross, 6) AS gross, round(net, 6) AS net, bars, early"
_add("backtest_trades", lambda s, d: recurrences.trades(frame(s, d)).selectExpr("symbol", "entry_h", "exit_h", "round(entry, 6) AS entry", "round(exit, 6) AS exit_price", "round(gross, 6) AS gross", "round(net, 6) AS net", "bars"), f"WITH RECURSIVE {_ledger()} SELECT symbol, entry_h, exit_h, round(entry, 6) AS entry, round(exit_, 6) AS exit_price, round(gross, 6) AS gross, round(net, 6) AS net, bars FROM tn")
_add("backtest_trades_early_exit", lambda s, d: s.sql(f"SELECT symbol, entry_h, exit_h, {_TRADE} FROM {{t}}", t=recurrences.trades(frame(s, d), exit_below=0.45)), f"WITH RECURSIVE {_ledger('0.45')} SELECT symbol, entry_h, exit_h, {_TRADE} FROM tn")
_METRICS = "count(*) AS n_trades, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(net), 6) AS avg_net, round(PCT_[net; 0.5], 6) AS median_net, round(max(net), 6) AS best, round(min(net), 6) AS worst, round(sum(CASE WHEN net > 0 THEN net END) / nullif(-sum(CASE WHEN net < 0 THEN net END), 0), 6) AS profit_factor, round(avg(CASE WHEN net > 0 THEN net END) / nullif(-avg(CASE WHEN net < 0 THEN net END), 0), 6) AS payoff, round(avg(bars), 6) AS avg_bars, round(avg(gross - net) * 10000, 4) AS cost_bps"
_add("backtest_metrics", lambda s, d: s.sql(in_spark(f"SELECT symbol, {_METRICS} FROM {{t}} GROUP BY symbol"), t=recurrences.trades(frame(s, d))), f"WITH RECURSIVE {_ledger()} SELECT symbol, {_METRICS} FROM tn GROUP BY symbol")

# equity by bar and the report; amounts are shown as logarithms, since the tables' prices jump and capital grows or shrinks by many powers of ten
_EQUITY_SQL = """pr AS (SELECT *, exit_ * 0.999 / (entry * 1.001) AS growth FROM tn),
    pb AS (SELECT *, CAST(10000 AS DOUBLE) * coalesce(product(growth) OVER (PARTITION BY symbol ORDER BY entry_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM pr),
    pt AS (SELECT *, before * growth AS after, before / (entry * 1.001) AS units, before / (entry * 1.001) * (entry + exit_) * 0.001 AS fees, before / (entry * 1.001) * (entry - raw_entry + raw_exit - exit_) AS slippage, before * growth - before AS pnl FROM pb),
    eq AS (SELECT g.symbol, g.h, g.close, CASE WHEN pt.entry_h IS NULL THEN 10000 WHEN g.h <= pt.exit_h THEN pt.units * g.close ELSE pt.after END AS equity, coalesce(g.h <= pt.exit_h, false) AS in_position FROM g ASOF LEFT JOIN pt ON g.symbol = pt.symbol AND g.h >= pt.entry_h)"""
_CURVE_SQL = f"{_ledger('0.45')}, {_EQUITY_SQL}"
_AMOUNTS = ["final_capital", "total_pnl", "total_return", "cagr", "calmar", "fees_paid", "slippage_paid", "costs_paid", "costs_bps", "gross_profit", "gross_loss", "profit_factor", "excess_vs_buy_hold"]
_SHARES = ["initial_capital", "max_drawdown", "volatility", "sharpe", "sortino", "buy_hold_return", "buy_hold_net", "time_in_market", "win_rate", "payoff_ratio", "avg_trade", "median_trade", "best_trade", "worst_trade", "avg_hold"]
_REPORTED = ["symbol", "CAST(n_bars AS BIGINT) AS n_bars", "CAST(n_trades AS BIGINT) AS n_trades", "CAST(n_early AS BIGINT) AS n_early", *(f"round(sign({c}) * log10(1 + abs({c})), 6) AS {c}_log" for c in _AMOUNTS), *(f"round({c}, 6) AS {c}" for c in _SHARES)]
_EQUITY = "symbol, h, round(log10(equity), 6) AS equity_log, in_position"


def _backtest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = frame(spark, sf_dir)
    ledger = backtest.priced(recurrences.trades(bars, exit_below=0.45))
    return backtest.equity(bars, ledger), ledger


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = _backtest(spark, sf_dir)
    c, ledger = spark.sql(in_spark(backtest.constants(backtest.CURVE)), e=e), spark.sql(in_spark(backtest.LEDGER), t=t)
    return spark.sql(in_spark(backtest.constants(backtest.REPORT)), c=c, l=ledger).selectExpr(*_REPORTED)


_add("backtest_equity", lambda s, d: s.sql(f"SELECT {_EQUITY} FROM {{e}}", e=_backtest(s, d)[0]), f"WITH RECURSIVE {_CURVE_SQL} SELECT {_EQUITY} FROM eq")
_add("backtest_report", _report, f"WITH RECURSIVE {_CURVE_SQL}, cv AS ({backtest.constants(backtest.CURVE).replace('{e}', 'eq')}), ld AS ({backtest.LEDGER.replace('{t}', 'pt')}), rp AS ({backtest.constants(backtest.REPORT).replace('{c}', 'cv').replace('{l}', 'ld')}) SELECT {', '.join(_REPORTED)} FROM rp")

# thresholds by backtest, on the rows before the last 15 % of the hours; amounts as logarithms again
_SPAN = "SELECT CAST(min(h) AS BIGINT) + CAST(floor((max(h) - min(h)) * CAST(0.85 AS DOUBLE)) AS BIGINT) - 6 AS last_h FROM"


def _before_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = frame(spark, sf_dir)
    return spark.sql(f"SELECT * FROM {{b}} WHERE h < ({_SPAN} {{b}})", b=bars)


# each (symbol, part, threshold) is a series of its own
_SERIES = f"""k AS (SELECT CAST(30 + 2 * i AS INTEGER) AS percent FROM range({len(thresholds.GRID)}) r(i)),
    p0 AS (SELECT v.symbol AS name, v.h, v.prob, c.open, c.close, row_number() OVER (PARTITION BY v.symbol ORDER BY v.h) AS place, count(*) OVER (PARTITION BY v.symbol) AS many FROM v JOIN c ON v.symbol = c.symbol AND v.h = c.h WHERE v.h < ({_SPAN} v)),
    p1 AS (SELECT p0.*, 'all' AS part FROM p0 UNION ALL SELECT p0.*, CASE WHEN place <= floor(many / 2) THEN 'first' ELSE 'second' END FROM p0),
    g AS (SELECT name || '@' || part || '@' || percent AS symbol, name, part, percent, h, prob, open, close, percent / 100e0 AS threshold, row_number() OVER (PARTITION BY name, part, percent ORDER BY h) AS i, count(*) OVER (PARTITION BY name, part, percent) AS n FROM p1 CROSS JOIN k),"""
_LEDGER_SQL = _ledger()
_SERIES_SQL = f"""WITH RECURSIVE {_LEDGER_SQL[: _LEDGER_SQL.index(' g AS (')]} {_SERIES}
    {_LEDGER_SQL[_LEDGER_SQL.index('sx AS ('):].replace('g.prob >= 0.6', 'g.prob >= g.threshold')}, {_EQUITY_SQL},
    cv AS ({backtest.constants(backtest.CURVE).replace('{e}', 'eq')}), ld AS ({backtest.LEDGER.replace('{t}', 'pt')}), rp AS ({backtest.constants(backtest.REPORT).replace('{c}', 'cv').replace('{l}', 'ld')}),
    cu AS (SELECT n.name AS symbol, n.part, n.percent, rp.* EXCLUDE (symbol) FROM rp JOIN (SELECT DISTINCT symbol, name, part, percent FROM g) n ON n.symbol = rp.symbol)"""
_RATED = ["symbol", "percent / CAST(100 AS DOUBLE) AS threshold", "CAST(n_trades AS BIGINT) AS n_trades", *(f"round(sign({c}) * log10(1 + abs({c})), 6) AS {c}_log" for c in ("total_return", "excess_vs_buy_hold", "profit_factor")), *(f"round({c}, 6) AS {c}" for c in ("win_rate", "sharpe", "sortino", "max_drawdown", "time_in_market"))]
_CHOSEN = ["symbol", "threshold", "CAST(n_trades AS BIGINT) AS n_trades", "round(sign(objective) * log10(1 + abs(objective)), 6) AS objective_log", "enough_trades", "first_half", "second_half", "compared", "agrees"]
_PLACED = "SELECT symbol, part, percent, n_trades, objective FROM (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY {order}) AS place FROM (SELECT *, excess_vs_buy_hold AS objective FROM cu) w WHERE {where}) q WHERE place = 1"
_CHOICES = f"""{_SERIES_SQL}, chosen AS ({_PLACED.format(order=thresholds.choice(30), where="part = 'all'")}), halves AS ({_PLACED.format(order=thresholds.choice(10), where="part <> 'all' AND n_trades >= 10 AND excess_vs_buy_hold IS NOT NULL")}),
    sizes AS (SELECT name AS symbol, count(*) AS n FROM p0 GROUP BY name), st AS ({thresholds.stability(30).replace('{chosen}', 'chosen').replace('{halves}', 'halves').replace('{sizes}', 'sizes')})"""
_add("threshold_curve", lambda s, d: thresholds.curve(_before_test(s, d)).selectExpr(*_RATED), f"{_SERIES_SQL} SELECT {', '.join(_RATED)} FROM cu WHERE part = 'all'")
_add("threshold_selection", lambda s, d: thresholds.select(_before_test(s, d)).selectExpr(*_CHOSEN), f"{_CHOICES} SELECT {', '.join(_CHOSEN)} FROM st")

def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.split(frame(spark, sf_dir))[0].where("label IS NOT NULL")


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability, on the test rows, of probabilities calibrated on the training rows."""
    return classifiers.reliability(classifiers.calibrated(_labelled(spark, sf_dir), ["mom", "prob", "r1"])(models.split(frame(spark, sf_dir))[2]))


# --- resampling, models, streams -----------------------------------------------------------------------------
_add("bootstrap_block_auc", lambda s, d: bootstrap.paired_block_auc(frame(s, d), "mom", "prob", blocks=24, resamples=1000))
_add("bootstrap_sharpe", lambda s, d: bootstrap.stationary_sharpe(frame(s, d).selectExpr("symbol", "h", "greatest(least(r1, 0.5), -0.5) * 0.01 AS net"), resamples=1000))
_add("model_walk_forward", lambda s, d: models.walk_forward(frame(s, d), ["mom", "prob", "r1"], folds=3, purge=6))
_add("model_selection", lambda s, d: models.select(frame(s, d), ["mom", "prob", "r1"]))
_add("model_importance_top_k", lambda s, d: models.gain_importance(frame(s, d), ["mom", "prob", "r1"]))
_add("model_per_asset_vs_global", lambda s, d: models.per_asset(frame(s, d), ["mom", "prob", "r1"]))
_add("model_permutation_importance", lambda s, d: models.permutation_importance(frame(s, d), ["mom", "prob", "r1"]))
_add("model_ablation", lambda s, d: models.ablation(frame(s, d), {"trend": ["mom"], "flow": ["prob", "r1"]}))
_add("model_classifiers", lambda s, d: classifiers.select(frame(s, d), ["mom", "prob", "r1"]))
_add("model_calibrated", lambda s, d: _calibrated(s, d))
_add("model_latest", lambda s, d: classifiers.latest(classifiers.pipeline("logistic", ["mom", "prob", "r1"]).fit(_labelled(s, d)), frame(s, d)))
_add("streaming_candles", lambda s, d: replay(s, d).selectExpr("symbol", "h", "trades", "round(high, 6) AS high", "round(low, 6) AS low", "round(volume, 6) AS volume"), f"WITH {HOURS} SELECT symbol, h, CAST(trades AS BIGINT) AS trades, round(high, 6) AS high, round(low, 6) AS low, round(volume, 6) AS volume FROM c")
