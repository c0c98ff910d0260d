"""Sequential recurrences by symbol, where no window form exists: smoothing, greedy choice, trade ledgers.

Each group is one symbol's candles in order (hours, not events), a bounded series; symbols run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smooth(x: np.ndarray, alpha: float) -> np.ndarray:
    """e[t] = alpha * x[t] + (1 - alpha) * e[t - 1] from the first value on; null until there is one, and carried over nulls."""
    out, last = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x.tolist()):
        if v == v:
            last = v if last != last else alpha * v + (1 - alpha) * last
        out[i] = last
    return out


def _span(n: int) -> float:
    return 2.0 / (n + 1)


def oscillators(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, wilder: int = 14) -> DataFrame:
    """symbol, h, ema_fast, ema_slow, macd, macd_signal, macd_histogram, rsi, atr and atr_percent (of close). Spans smooth with 2 / (n + 1), Wilder's measures with 1 / n, each from its first value."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("h")
        c = g["close"].to_numpy(float)
        f, s = smooth(c, _span(fast)), smooth(c, _span(slow))
        macd = f - s
        line = smooth(macd, _span(signal))
        step = np.diff(c, prepend=np.nan)
        up, down = smooth(np.where(step == step, np.maximum(step, 0), np.nan), 1 / wilder), smooth(np.where(step == step, np.maximum(-step, 0), np.nan), 1 / wilder)
        with np.errstate(all="ignore"):
            rsi = np.where(up + down > 1e-12, 100 * up / (up + down), np.nan)
        prev = np.concatenate([[np.nan], c[:-1]])
        high, low = g["high"].to_numpy(float), g["low"].to_numpy(float)
        tr = np.fmax(high - low, np.fmax(abs(high - prev), abs(low - prev)))
        atr = smooth(tr, 1 / wilder)
        percent = np.divide(100 * atr, c, out=np.full(len(c), np.nan), where=np.abs(c) > 1e-12)
        return pd.DataFrame({"symbol": g["symbol"], "h": g["h"], "ema_fast": f, "ema_slow": s, "macd": macd, "macd_signal": line, "macd_histogram": macd - line, "rsi": rsi, "atr": atr, "atr_percent": percent}).replace({np.nan: None})

    return candles.select("symbol", "h", "high", "low", "close").groupBy("symbol").applyInPandas(run, "symbol string, h long, ema_fast double, ema_slow double, macd double, macd_signal double, macd_histogram double, rsi double, atr double, atr_percent double")


def entries(table: DataFrame, gap: int) -> DataFrame:
    """Rows (symbol, h) taken greedily: each at least ``gap`` after the one taken before."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken, last = [], None
        for h in sorted(group["h"].tolist()):
            if last is None or h - last >= gap:
                taken.append(h)
                last = h
        return pd.DataFrame({"symbol": group["symbol"].iloc[0], "h": taken})

    return table.select("symbol", "h").groupBy("symbol").applyInPandas(run, "symbol string, h long")


def _price(x) -> bool:
    return x is not None and x == x and 0 < x < float("inf")


def trades(table: DataFrame, threshold: float | str = 0.6, hold: int = 6, cost: float = 0.001, slip: float = 0.0005, exit_below: float | None = None) -> DataFrame:
    """Trade ledger of (symbol, h, open, close, prob): a signal at row t enters at the open of t + 1 and leaves at the close of t + hold (or the last row), or
    earlier at the close of the first row after the entry's whose prob is under ``exit_below``. Signals count again after the row of the exit, so no trades overlap;
    one on the last row gives none, nor do prices that are null or not above 0. Null and NaN probs are no signal.
    ``threshold`` is a number or the name of a column that holds one number by symbol.

    Returns symbol, entry_h, exit_h, raw_entry, raw_exit, entry and exit (with slippage), gross (of raw prices), net (after slippage and costs at both ends), bars and early.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("h")
        least = g["threshold"].iloc[0]
        h, o, c, p = g["h"].tolist(), g["open"].tolist(), g["close"].tolist(), g["prob"].tolist()
        out, t = [], 0
        while t < len(h) - 1:
            if p[t] is None or not p[t] >= least or not _price(o[t + 1]):
                t += 1
                continue
            a, b = t + 1, min(t + hold, len(h) - 1)
            low = [] if exit_below is None else [i for i in range(a + 1, b + 1) if p[i] is not None and p[i] < exit_below]
            b = low[0] if low else b
            if _price(c[b]):
                entry, leave = o[a] * (1 + slip), c[b] * (1 - slip)
                out.append((g["symbol"].iloc[0], h[a], h[b], o[a], c[b], entry, leave, c[b] / o[a] - 1, leave / entry * (1 - cost) ** 2 - 1, b - a + 1, bool(low)))
            t = b + 1
        return pd.DataFrame(out, columns=["symbol", "entry_h", "exit_h", "raw_entry", "raw_exit", "entry", "exit", "gross", "net", "bars", "early"])

    given = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return table.select("symbol", "h", "open", "close", "prob", given.alias("threshold")).groupBy("symbol").applyInPandas(run, "symbol string, entry_h long, exit_h long, raw_entry double, raw_exit double, entry double, exit double, gross double, net double, bars long, early boolean")
