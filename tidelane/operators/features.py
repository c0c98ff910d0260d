"""Causal features of candle tables, group by group.

A group is a list of layers; a layer's expressions read the columns of the layers before, so that no window
stands within a window. All windows share one partitioning and order, so a group is one shuffle
and one sort. Window lengths are in rows of the candle table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelane.functions.portable import change, lag, ratio, roll, zscore

Layers = list[dict[str, str]]


def technical(returns=(1, 3, 6, 12, 24), sma=(10, 20, 50, 100, 200), volatility=(20, 50), band=20, volume=20, roc=12, bars_a_year=8760) -> Layers:
    """Returns, moving averages, volatility, bands, volume and candle shape (recurrences are in ``recurrences``)."""
    first = {f"return_{p}h": change("close", p) for p in returns}
    first |= {f"sma_{p}": roll("avg", "close", p) for p in sma}
    first |= {"log_return": f"CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END"}
    first |= {"bb_middle": roll("avg", "close", band), "bb_std": roll("stddev_samp", "close", band), f"volume_sma_{volume}": roll("avg", "volume", volume)}
    first |= {"volume_change": ratio(f"volume - {lag('volume', 6)}", lag("volume", 6)), f"roc_{roc}": f"100 * ({change('close', roc)})"}
    first |= {"candle_body": ratio("close - open", "open"), "candle_range": ratio("high - low", "open"), "upper_wick": ratio("high - greatest(open, close)", "open"), "lower_wick": ratio("least(open, close) - low", "open")}
    first |= {"true_range": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"}
    second = {f"price_vs_sma{p}": f"{ratio('close', f'sma_{p}')} - 1" for p in sma}
    second |= {f"sma{a}_vs_sma{b}": f"{ratio(f'sma_{a}', f'sma_{b}')} - 1" for a, b in zip(sma[:-1], sma[1:], strict=True)}
    second |= {"sma50_vs_sma200": f"{ratio('sma_50', 'sma_200')} - 1"} if {50, 200} <= set(sma) else {}
    second |= {f"rolling_volatility_{w}": f"({roll('stddev_samp', 'log_return', w)}) * sqrt({bars_a_year}.0)" for w in volatility}
    second |= {"bb_upper": "bb_middle + 2 * bb_std", "bb_lower": "bb_middle - 2 * bb_std", "volume_ratio": ratio("volume", f"volume_sma_{volume}"), "body_to_range": ratio("candle_body", "candle_range")}
    third = {"bb_width": ratio("bb_upper - bb_lower", "bb_middle"), "bb_position": ratio("close - bb_lower", "bb_upper - bb_lower")}
    return [first, second, third]


def microstructure(long=480, least=160) -> Layers:
    """Trade counts, sizes, imbalance and order flow."""
    first = {
        "trade_count": "CAST(trades AS DOUBLE)",
        "trade_intensity": ratio("trades", "quote_volume", "0"),
        "avg_trade_size": ratio("quote_volume", "trades"),
        "sell_volume": "volume - taker_buy_volume",
        "price_step": f"close - {lag('close')}",
        "quote_volume_zscore": zscore("quote_volume", long, least),
    }
    second = {
        "trade_count_ratio": ratio("trade_count", roll("avg", "trade_count", 20, 5)),
        "trade_count_zscore": zscore("trade_count", long, least),
        "avg_trade_size_ratio": ratio("avg_trade_size", roll("avg", "avg_trade_size", 20, 5)),
        "volume_per_trade_cv_20": ratio(roll("stddev_pop", "avg_trade_size", 20, 10), roll("avg", "avg_trade_size", 20, 10)),
        "aggressive_buy_ratio": ratio("taker_buy_volume", "volume"),
        "aggressive_sell_ratio": ratio("sell_volume", "volume"),
        "buy_sell_ratio": ratio("taker_buy_volume", "sell_volume"),
        "order_imbalance_1h": ratio("taker_buy_volume - sell_volume", "volume"),
        "order_imbalance_5h": ratio(roll("sum", "(taker_buy_volume - sell_volume)", 5, 2), roll("sum", "volume", 5, 2)),
        "order_imbalance_15h": ratio(roll("sum", "(taker_buy_volume - sell_volume)", 15, 7), roll("sum", "volume", 15, 7)),
    }
    third = {
        "volume_imbalance": "order_imbalance_1h",
        "order_imbalance_zscore": zscore("order_imbalance_1h", long, least),
        "taker_buy_ratio_mean_5": roll("avg", "aggressive_buy_ratio", 5, 2),
        "taker_buy_ratio_mean_15": roll("avg", "aggressive_buy_ratio", 15, 5),
        "taker_buy_ratio_change_1h": f"aggressive_buy_ratio - {lag('aggressive_buy_ratio')}",
        "flow_price_divergence": "CAST(sign(order_imbalance_1h) * sign(price_step) AS DOUBLE)",
    }
    return [first, second, third]


def derivatives(long=180, least=60, basis=240) -> Layers:
    """Funding and basis; reads close, volume, trades, funding_rate, futures_price, futures_volume, futures_trades and futures_taker_buy. Windows are rows of the aligned grid. A null rate counts as not positive; it has no streak of its own, and neither ends one nor stops its count."""
    run = "sum(streak_break) OVER (PARTITION BY symbol ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    first = {
        "funding_rate_abs": "abs(funding_rate)",
        "funding_rate_change": f"funding_rate - {lag('funding_rate', 3)}",
        "funding_rate_mean_3": roll("avg", "funding_rate", 3, 1),
        "funding_rate_mean_10": roll("avg", "funding_rate", 10, 1),
        "funding_cumulative_24h": roll("sum", "funding_rate", 3, 1),
        "funding_rate_zscore_20": zscore("funding_rate", 20),
        "funding_zscore_60d": zscore("funding_rate", long, least),
        "funding_positive": "CASE WHEN funding_rate > 0 THEN 1.0 ELSE 0.0 END",
        "funding_sign": "CAST(sign(funding_rate) AS INT)",
        "futures_volume_ratio": ratio("futures_volume", roll("avg", "futures_volume", 20)),
        "futures_volume_change": f"futures_volume - {lag('futures_volume')}",
        "futures_price_return_1h": change("futures_price"),
        "futures_taker_buy_ratio": ratio("futures_taker_buy", "futures_volume"),
        "futures_spot_basis": f"{ratio('futures_price', 'close')} - 1",
        "futures_spot_volume_ratio": ratio("futures_volume", "volume"),
        "futures_trades_ratio": ratio("futures_trades", "trades"),
    }
    second = {
        "funding_positive_share_60d": roll("avg", "funding_positive", long, least),
        "streak_break": f"CASE WHEN funding_sign <> {lag('funding_sign')} THEN 1 ELSE 0 END",
        "futures_spot_basis_mean_24": roll("avg", "futures_spot_basis", 24, 6),
        "futures_spot_basis_mean_7d": roll("avg", "futures_spot_basis", 168, 24),
        "futures_basis_zscore_60d": zscore("futures_spot_basis", basis),
        "futures_basis_change_1h": f"futures_spot_basis - {lag('futures_spot_basis')}",
    }
    third = {"streak_run": run}
    fourth = {"funding_streak": "CAST(funding_sign * row_number() OVER (PARTITION BY symbol, streak_run ORDER BY h) AS BIGINT)"}
    return [first, second, third, fourth]


def sentiment(long=90, least=30) -> Layers:
    """Daily index features; reads value, one row a day, h the day."""
    first = {
        "change": f"value - {lag('value')}",
        "change_3d": f"value - {lag('value', 3)}",
        "mean_7": roll("avg", "value", 7, 1),
        "mean_30": roll("avg", "value", 30, 3),
        "std_30": roll("stddev_pop", "value", 30, 5),
        "zscore_90d": zscore("value", long, least),
        "range_30d": f"({roll('max', 'value', 30, 5)}) - ({roll('min', 'value', 30, 5)})",
        "regime": "CASE WHEN value <= 25 THEN 0 WHEN value <= 45 THEN 1 WHEN value <= 55 THEN 2 WHEN value <= 75 THEN 3 WHEN value IS NOT NULL THEN 4 END",
    }
    second = {
        "above_ma30": "CASE WHEN value > mean_30 THEN 1 ELSE 0 END",
        "regime_change": f"regime - {lag('regime')}",
        "moved": "CASE WHEN abs(change) >= 5 THEN 1 ELSE 0 END",
    }
    third = {"quiet_run": "sum(1 - moved) OVER (PARTITION BY symbol ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}
    fourth = {"days_since_change": "CAST(sum(moved) OVER (PARTITION BY symbol, quiet_run ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"}
    return [first, second, third, fourth]


def context() -> Layers:
    """Features of completed higher-timeframe bars on the grid rows; reads c4, v4 (4 h) and c1 (1 d) joined as of."""
    first = {
        "ctx_4h_return_1": change("c4"),
        "ctx_4h_return_3": change("c4", 3),
        "ctx_4h_volume_ratio": ratio("v4", roll("avg", "v4", 20, 5)),
        "ctx_1d_return_1": change("c1"),
        "ctx_1d_return_3": change("c1", 3),
    }
    second = {
        "ctx_4h_volatility": roll("stddev_pop", "ctx_4h_return_1", 20, 8),
        "ctx_1d_volatility": roll("stddev_pop", "ctx_1d_return_1", 30, 10),
        "ctx_vol_10": roll("stddev_pop", "ctx_1d_return_1", 10, 5),
        "htf_bias": "(sign(ctx_4h_return_1) + sign(ctx_1d_return_1)) / 2.0",
    }
    return [first, second, {"vol_regime_ratio": ratio("ctx_vol_10", "ctx_1d_volatility")}]


def names(layers: Layers, *without: str) -> list[str]:
    return [n for layer in layers for n in layer if n not in without]


def add(table: DataFrame, layers: Layers) -> DataFrame:
    """The table with the layers' columns."""
    for layer in layers:
        table = table.selectExpr("*", *(f"{e} AS {n}" for n, e in layer.items()))
    return table


def sql(source: str, layers: Layers) -> str:
    """The same as common table expressions over ``source`` (a SELECT); the last is named ``f``."""
    parts = [f"f0 AS ({source})"]
    for k, layer in enumerate(layers):
        parts.append(f"f{k + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM f{k})")
    return ", ".join([*parts, f"f AS (SELECT * FROM f{len(layers)})"])
