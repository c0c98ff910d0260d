"""Plans of the market-analytics operators as SQL that Spark and DuckDB both run.

Each is a chain of common table expressions over ``{events}`` or ``{orders}``; Spark gets the tables as
DataFrames, so Catalyst prunes columns and merges scans, and candles are aggregated before any window or join.
"""

from __future__ import annotations

from tidelane.functions.portable import average_rank, digits, lag, lead, over, roll, wilson
from tidelane.sources.candles import DAILY, HOURLY, HOURLY_ALL

HOURS = f"c AS ({HOURLY})"
ALL = f"a AS ({HOURLY_ALL})"
DAYS = f"d AS ({DAILY})"
def rounded(*columns: str) -> str:
    return ", ".join(f"{digits(c)} AS {c}" for c in columns)


PLANS: dict[str, str] = {}


def plan(name: str, *ctes: str, select: str) -> None:
    PLANS[name] = f"WITH {', '.join(ctes)} {select}" if ctes else select


OHLCV = "CAST(trades AS BIGINT) AS trades, " + rounded("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")

# --- sources, cleaning, gaps ---------------------------------------------------------------------------------
plan("candles_hourly", HOURS, select=f"SELECT symbol, h, {OHLCV} FROM c")
plan("candles_all", ALL, select=f"SELECT symbol, h, {OHLCV} FROM a")
plan("candles_daily", DAYS, select="SELECT symbol, h, CAST(trades AS BIGINT) AS trades, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, round(volume, 2) AS volume, round(quote_volume / 1000000, 2) AS quote_millions, round(taker_buy_volume, 2) AS taker_buy_volume FROM d")
plan("scan_project_filter", select="SELECT event_id, user_id, round(value, 6) AS amount FROM {events} WHERE event_type = 'purchase' AND value > 50")
# two loads with overlap: within one the first of a key stays, between two the newer
_LOADS = """raw AS (
    SELECT symbol, h, close, 0 AS load, h AS seq FROM c WHERE h % 3 <> 0
    UNION ALL SELECT symbol, h, close + 1, 0 AS load, h + 1 AS seq FROM c WHERE h % 6 = 1
    UNION ALL SELECT symbol, h, close + 2, 1 AS load, h AS seq FROM c WHERE h % 4 = 0)"""
plan("normalise_keep_first", HOURS, _LOADS, select="SELECT symbol, h, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, h ORDER BY load, seq, close) AS k FROM raw) t WHERE k = 1")
plan("merge_keep_newest", HOURS, _LOADS, select="SELECT symbol, h, round(close, 6) AS close, load FROM (SELECT *, row_number() OVER (PARTITION BY symbol, h ORDER BY load DESC, seq DESC, close DESC) AS k FROM raw) t WHERE k = 1")
plan("drop_incomplete_candle", HOURS, select="SELECT symbol, h, round(close, 6) AS close FROM c WHERE h + 1 <= (SELECT max(h) FROM c)")
_GRID = "g AS (SELECT symbol, SEQ_[min(h); max(h)] AS h FROM c GROUP BY symbol)"
_MISSING = "m AS (SELECT g.symbol, g.h, g.h - row_number() OVER (PARTITION BY g.symbol ORDER BY g.h) AS island FROM g LEFT JOIN c ON g.symbol = c.symbol AND g.h = c.h WHERE c.h IS NULL)"
plan("missing_ranges", HOURS, _GRID, _MISSING, select="SELECT symbol, min(h) AS first_missing, max(h) AS last_missing, count(*) AS n_missing FROM m GROUP BY symbol, island")
plan("missing_rows_anti_join", HOURS, _GRID, select="SELECT g.symbol, g.h FROM g ANTI_JOIN c ON g.symbol = c.symbol AND g.h = c.h")
plan("price_filter_report", HOURS, select="""SELECT symbol, count(*) AS n_input, count(CASE WHEN close > 20 THEN 1 END) AS n_kept,
    count(CASE WHEN NOT (close > 20) OR close IS NULL THEN 1 END) AS n_dropped_price FROM c GROUP BY symbol""")
plan("source_cadence", HOURS, f"s AS (SELECT symbol, h - {lag('h')} AS step FROM c)", "k AS (SELECT symbol, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY symbol, step)", select="SELECT symbol, step, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, step) AS r FROM k) t WHERE r = 1")
plan("recent_rows", HOURS, select="SELECT symbol, h, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY h DESC) AS r FROM c) t WHERE r <= 48")
plan("resample_4h", HOURS, select="SELECT symbol, CAST(floor(h / 4) AS BIGINT) AS bar, round(min_by(open, h), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(max_by(close, h), 6) AS close, round(sum(volume), 6) AS volume FROM c GROUP BY 1, 2")
plan("daily_last", HOURS, select="SELECT symbol, CAST(floor(h / 24) AS BIGINT) AS day, round(max_by(close, h), 6) AS close FROM c GROUP BY 1, 2")

# --- quality -------------------------------------------------------------------------------------------------
_CHECKED = f"""x AS (SELECT symbol, h, open, high, low, close, volume, CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END AS r FROM c)"""
_MED = "med AS (SELECT symbol, PCT_[r; 0.5] AS m FROM x GROUP BY symbol)"
_MAD = "mad AS (SELECT x.symbol, min(med.m) AS m, 1.4826 * PCT_[abs(r - m); 0.5] AS s FROM x JOIN med ON x.symbol = med.symbol GROUP BY x.symbol)"
_CHECKS = {
    "duplicate_timestamps": ("error", "SELECT symbol, count(*) AS n FROM (SELECT symbol, h FROM raw GROUP BY symbol, h HAVING count(*) > 1) t GROUP BY symbol"),
    "ordering": ("error", "SELECT symbol, count(*) AS n FROM (SELECT symbol, h, lag(h) OVER (PARTITION BY symbol ORDER BY load, seq, close) AS p FROM raw) t WHERE h <= p GROUP BY symbol"),
    "missing_timestamps": ("error", "SELECT symbol, count(*) AS n FROM m GROUP BY symbol"),
    "ohlc_consistency": ("error", "SELECT symbol, count(*) AS n FROM c WHERE NOT coalesce(high >= open AND high >= close AND low <= open AND low <= close, false) GROUP BY symbol"),
    "null_values": ("error", f"SELECT symbol, sum({' + '.join(f'CASE WHEN {x} IS NULL THEN 1 ELSE 0 END' for x in ('open', 'high', 'low', 'close', 'volume'))} + CASE WHEN {' OR '.join(f'{x} IS NULL OR abs({x}) > 1e308' for x in ('open', 'high', 'low', 'close'))} THEN 1 ELSE 0 END) AS n FROM c GROUP BY symbol"),
    "positive_prices": ("error", "SELECT symbol, count(*) AS n FROM c WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 GROUP BY symbol"),
    "non_negative_volume": ("error", "SELECT symbol, count(*) AS n FROM c WHERE volume < 0 OR abs(volume) > 1e308 GROUP BY symbol"),
    "abnormal_gaps": ("warning", "SELECT symbol, count(*) AS n FROM (SELECT symbol, island FROM m GROUP BY symbol, island HAVING count(*) > 2) t GROUP BY symbol"),
    "price_outliers": ("warning", "SELECT x.symbol, count(*) AS n FROM x JOIN mad ON x.symbol = mad.symbol WHERE mad.s > 0 AND abs(r - mad.m) / mad.s > 3 AND abs(r - mad.m) > 0.35 GROUP BY x.symbol"),
    "zero_volume": ("warning", "SELECT symbol, count(*) AS n FROM (SELECT symbol, volume, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol) AS share FROM c) t WHERE volume = 0 AND share > 0.01 GROUP BY symbol"),
    "future_candles": ("error", "SELECT symbol, count(*) AS n FROM c WHERE h * 3600 > (SELECT max(EPOCH_[ts]) FROM {events}) GROUP BY symbol"),
    # of the rows as they came, in seconds: candles made of them stand on the grid by themselves
    "interval_alignment": ("error", "SELECT event_type AS symbol, count(*) AS n FROM {events} WHERE EPOCH_[ts] % 1 <> 0 GROUP BY event_type"),
}
_UNION = " UNION ALL ".join(f"SELECT s.symbol, '{k}' AS check_name, '{sev}' AS severity, CAST(coalesce(n, 0) AS BIGINT) AS n_failed FROM (SELECT DISTINCT symbol FROM c) s LEFT JOIN ({q}) q ON s.symbol = q.symbol" for k, (sev, q) in _CHECKS.items())
plan("validate", HOURS, _LOADS, _GRID, _MISSING, _CHECKED, _MED, _MAD, select=f"SELECT symbol, check_name, severity, n_failed, n_failed = 0 AS passed FROM ({_UNION}) t")
plan("validation_status", HOURS, _LOADS, _GRID, _MISSING, _CHECKED, _MED, _MAD, select=f"""SELECT symbol, CASE WHEN sum(CASE WHEN severity = 'error' AND n_failed > 0 THEN 1 ELSE 0 END) > 0 THEN 'FAIL' WHEN sum(n_failed) > 0 THEN 'WARN' ELSE 'PASS' END AS status, CAST(sum(n_failed) AS BIGINT) AS n_failed FROM ({_UNION}) t GROUP BY symbol""")
plan("series_statistics", HOURS, select="SELECT symbol, count(*) AS n, min(h) AS first_h, max(h) AS last_h, max(h) - min(h) + 1 AS expected, round(min(close), 6) AS min_close, round(max(close), 6) AS max_close, round(avg(close), 6) AS mean_close, round(sum(volume), 4) AS total_volume, round(max_by(close, h) / min_by(close, h) - 1, 6) AS total_return FROM c GROUP BY symbol")

# --- as-of joins ---------------------------------------------------------------------------------------------
# the source: eight-hour bars of clicks, known at the bar's end; every fifth value is missing
_FUNDING = "s AS (SELECT bar * 8 + 8 AS known, CASE WHEN bar % 5 = 0 THEN NULL ELSE v END AS v FROM (SELECT CAST(floor(h / 8) AS BIGINT) AS bar, (max_by(close, h) - 50) / 1000 AS v FROM c WHERE symbol = 'click' GROUP BY 1) t)"
_TARGET = "t AS (SELECT symbol, h, close FROM c WHERE symbol = 'purchase')"
_ASOF = """u AS (SELECT known AS h, 0 AS side, known AS src, v, CAST(NULL AS DOUBLE) AS close FROM s UNION ALL SELECT h, 1 AS side, NULL AS src, NULL AS v, close FROM t),
    n AS (SELECT *, count(src) OVER (ORDER BY h, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM u),
    j AS (SELECT h, side, close, max(src) OVER (PARTITION BY grp) AS source_h, max(v) OVER (PARTITION BY grp) AS v FROM n)"""
_AGED = "CASE WHEN h - source_h <= 12 THEN round(v, 6) END"
plan("asof_join", HOURS, _FUNDING, _TARGET, _ASOF, select=f"SELECT h, round(close, 6) AS close, source_h, {_AGED} AS v FROM j WHERE side = 1")
plan("asof_audit", HOURS, _FUNDING, _TARGET, _ASOF, select="SELECT count(*) AS n_rows, count(CASE WHEN source_h > h THEN 1 END) AS n_ahead, count(CASE WHEN v IS NOT NULL AND source_h IS NULL THEN 1 END) AS n_unsourced, count(CASE WHEN h - source_h > 12 THEN 1 END) AS n_stale FROM j WHERE side = 1")
plan("source_coverage", HOURS, _FUNDING, _TARGET, _ASOF, select=f"SELECT count(*) AS n, count({_AGED}) AS n_covered, round(count({_AGED}) * 100.0 / count(*), 4) AS coverage_pct FROM j WHERE side = 1")
plan("availability_matrix", HOURS, "cat AS (SELECT 'click' AS source, 'flow' AS grp UNION ALL SELECT 'view', 'flow' UNION ALL SELECT 'signup', 'sentiment' UNION ALL SELECT 'order_book', 'depth')", "k AS (SELECT symbol, count(*) AS n, min(h) AS first_h FROM c GROUP BY symbol)", select="SELECT source, grp, coalesce(n, 0) AS n, first_h, n IS NOT NULL AS available FROM cat LEFT JOIN k ON source = symbol")
plan("label_asof_close", HOURS, f"e AS (SELECT *, {lead('h')} AS nxt, max(h) OVER (PARTITION BY symbol) AS last_h FROM c)", select="SELECT a.symbol, a.h, round(b.close / a.close - 1, 6) AS future_return_6h FROM e a LEFT JOIN e b ON a.symbol = b.symbol AND a.h + 6 >= b.h AND (b.nxt IS NULL OR a.h + 6 < b.nxt) AND a.h + 6 <= a.last_h")
plan("common_rows_semi_join", HOURS, select="SELECT h FROM c WHERE symbol = 'click' INTERSECT SELECT h FROM c WHERE symbol = 'error' INTERSECT SELECT h FROM c WHERE symbol = 'signup'")
plan("difference_rows", HOURS, select="SELECT h FROM c WHERE symbol = 'click' EXCEPT SELECT h FROM c WHERE symbol = 'view'")

# --- labels, splits ------------------------------------------------------------------------------------------
_Y = f"y AS (SELECT symbol, h, close, {lead('close', 6)} / close - 1 AS fr FROM c)"
plan("label_binary", HOURS, _Y, select="SELECT symbol, h, round(fr, 6) AS future_return, CASE WHEN fr >= 0.05 THEN 1 WHEN fr IS NOT NULL THEN 0 END AS target FROM y")
plan("label_three_class", HOURS, _Y, select="SELECT symbol, h, CASE WHEN fr > 0.05 THEN 2 WHEN fr < -0.05 THEN 0 WHEN fr IS NOT NULL THEN 1 END AS target FROM y")
plan("label_horizons", ALL, select=f"SELECT h, {', '.join(f'round(({lead("close", k)}) / close - 1, 6) AS future_return_{k}h' for k in (1, 6, 24, 72))} FROM a")
plan("label_coverage", ALL, f"y AS (SELECT h, {', '.join(f'{lead("close", k)} AS f{k}' for k in (1, 6, 24, 72))} FROM a)", select=" UNION ALL ".join(f"SELECT {k} AS horizon, count(*) AS n, count(f{k}) AS n_labelled, max(CASE WHEN f{k} IS NOT NULL THEN h END) AS last_h FROM y" for k in (1, 6, 24, 72)))
plan("label_reaches_boundary", HOURS, select="SELECT symbol, h FROM c WHERE h + 24 >= (SELECT max(h) - 100 FROM c)")
_SPLIT = "p AS (SELECT symbol, h, row_number() OVER (PARTITION BY symbol ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM c), q AS (SELECT symbol, h, i, n, CAST(floor(n * 0.7) AS BIGINT) AS a, CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) AS b FROM p), sp AS (SELECT symbol, h, CASE WHEN i < a - 6 THEN 'train' WHEN i < a THEN NULL WHEN i < b - 6 THEN 'validation' WHEN i < b THEN NULL ELSE 'test' END AS split FROM q)"
plan("split_chronological", HOURS, _SPLIT, select="SELECT symbol, h, split FROM sp WHERE split IS NOT NULL")
plan("split_leakage_check", HOURS, _SPLIT, select="SELECT symbol, count(CASE WHEN split IS NULL THEN 1 END) AS n_purged, max(CASE WHEN split = 'train' THEN h END) + 6 <= min(CASE WHEN split = 'validation' THEN h END) AS train_ok, max(CASE WHEN split = 'validation' THEN h END) + 6 <= min(CASE WHEN split = 'test' THEN h END) AS validation_ok FROM sp GROUP BY symbol")
_POS = "p AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n FROM a)"
plan("cv_purged_folds", ALL, _POS, "k AS (SELECT SEQ_[CAST(0 AS BIGINT); CAST(4 AS BIGINT)] AS fold)", "b AS (SELECT fold, min(n) AS n, 200 + 6 AS lo, CAST(floor((min(n) - 206) / 5) AS BIGINT) AS w, (min(n) - 206) % 5 AS extra FROM p, k GROUP BY fold)", "f AS (SELECT fold, lo + fold * w + least(fold, extra) AS v0, lo + fold * w + least(fold, extra) + w + CASE WHEN fold < extra THEN 1 ELSE 0 END AS v1 FROM b)", select="SELECT fold, h, CASE WHEN i < v0 THEN 'train' ELSE 'validation' END AS part FROM f JOIN p ON i < v0 - 6 OR (i >= v0 AND i < v1)")
plan("walkforward_rolling", ALL, _POS, "k AS (SELECT SEQ_[CAST(0 AS BIGINT); CAST(3 AS BIGINT)] AS fold)", select="SELECT fold, h, CASE WHEN i >= fold * 60 + 200 + 6 THEN 'test' ELSE 'train' END AS part FROM p JOIN k ON (i >= fold * 60 AND i < fold * 60 + 200) OR (i >= fold * 60 + 206 AND i < fold * 60 + 266)")
plan("walkforward_embargo", ALL, "k AS (SELECT SEQ_[CAST(0 AS BIGINT); CAST(3 AS BIGINT)] AS fold)", "r AS (SELECT min(h) AS h0 FROM a)", "f AS (SELECT fold, h0 + 300 + fold * 100 AS t0 FROM k, r)", select="SELECT fold, h, CASE WHEN h >= t0 THEN 'test' WHEN h >= t0 - 24 - 60 THEN 'validation' ELSE 'train' END AS part FROM f JOIN a ON (h >= t0 AND h <= t0 + 100) OR (h >= t0 - 84 AND h < t0 - 24) OR h + 6 < t0 - 84")
plan("class_distribution", HOURS, _Y, select="SELECT symbol, CASE WHEN fr >= 0.05 THEN 1 ELSE 0 END AS target, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM y WHERE fr IS NOT NULL GROUP BY 1, 2")
plan("complete_rows", HOURS, _Y, f"z AS (SELECT *, {lag('close', 24)} AS l24 FROM y)", select="SELECT symbol, h FROM z WHERE fr IS NOT NULL AND l24 IS NOT NULL AND close IS NOT NULL")
plan("support_table", HOURS, "k AS (SELECT 1 AS horizon UNION ALL SELECT 24 UNION ALL SELECT 400)", "s AS (SELECT symbol, max(h) AS last_h FROM c GROUP BY symbol)", select="SELECT s.symbol, k.horizon, count(c.h) AS n_labelled, count(c.h) >= 200 AS supported FROM s CROSS JOIN k LEFT JOIN c ON c.symbol = s.symbol AND c.h + k.horizon <= s.last_h GROUP BY 1, 2")
plan("common_horizons", HOURS, "k AS (SELECT 1 AS horizon UNION ALL SELECT 24 UNION ALL SELECT 600)", "s AS (SELECT symbol, max(h) AS last_h FROM c GROUP BY symbol)", "n AS (SELECT c.symbol, k.horizon, count(*) AS n FROM c JOIN s ON c.symbol = s.symbol JOIN k ON c.h + k.horizon <= s.last_h GROUP BY 1, 2)", select="SELECT horizon, count(*) AS n_symbols FROM n WHERE n >= 200 GROUP BY horizon HAVING count(*) >= 2")

# --- prediction frames, metrics ------------------------------------------------------------------------------
PREDICTIONS = f"""w AS (SELECT symbol, h, close, {lead('close', 6)} / close - 1 AS y, close / {lag('close', 6)} - 1 AS mom, close / {lag('close', 1)} - 1 AS r1 FROM c),
    v AS (SELECT symbol, h, round(y, 9) AS y, round(mom, 9) AS mom, round(1 / (1 + exp(-2 * r1)), 6) AS prob, CASE WHEN y >= 0 THEN 1 ELSE 0 END AS label, r1 FROM w WHERE y IS NOT NULL AND mom IS NOT NULL AND r1 IS NOT NULL),
    m AS (SELECT symbol, h, 'momentum' AS model, y, 0.1 * mom AS pred FROM v UNION ALL SELECT symbol, h, 'reversal', y, -0.1 * mom FROM v UNION ALL SELECT symbol, h, 'zero', y, 0.0 FROM v)"""
_CM = "k AS (SELECT symbol, sum(CASE WHEN label = 1 AND prob >= 0.5 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN label = 0 AND prob >= 0.5 THEN 1.0 ELSE 0.0 END) AS fp, sum(CASE WHEN label = 1 AND prob < 0.5 THEN 1.0 ELSE 0.0 END) AS fn, sum(CASE WHEN label = 0 AND prob < 0.5 THEN 1.0 ELSE 0.0 END) AS tn FROM v GROUP BY symbol)"
plan("classification_metrics", HOURS, PREDICTIONS, _CM, select="""SELECT symbol, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
    round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
    round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
    round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM k""")
plan("roc_auc", HOURS, PREDICTIONS, f"r AS (SELECT symbol, label, {average_rank('prob', 'symbol')} AS rk FROM v)", select="SELECT symbol, round((sum(label * rk) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc FROM r GROUP BY symbol")
plan("pr_auc", HOURS, PREDICTIONS, "k AS (SELECT symbol, prob, sum(label) AS pos, count(*) AS n FROM v GROUP BY symbol, prob)", "z AS (SELECT symbol, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY symbol) AS total FROM k WINDOW w AS (PARTITION BY symbol ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", select="SELECT symbol, round(sum(pos * 1.0 / total * tp / seen), 6) AS average_precision FROM z GROUP BY symbol")
plan("probability_statistics", HOURS, PREDICTIONS, select="SELECT symbol, round(avg(prob), 6) AS mean_prob, round(stddev_pop(prob), 6) AS std_prob, round(PCT_[prob; 0.05], 6) AS p05, round(PCT_[prob; 0.5], 6) AS p50, round(PCT_[prob; 0.95], 6) AS p95 FROM v GROUP BY symbol")
plan("multiclass_metrics", HOURS, PREDICTIONS, "k AS (SELECT symbol, CASE WHEN y > 0.05 THEN 2 WHEN y < -0.05 THEN 0 ELSE 1 END AS t, CASE WHEN mom > 0.05 THEN 2 WHEN mom < -0.05 THEN 0 ELSE 1 END AS p FROM v)", select="SELECT symbol, t, p, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY symbol, t), 6) AS share_of_true, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY symbol, p), 6) AS share_of_predicted FROM k GROUP BY symbol, t, p")
plan("calibration_error", HOURS, PREDICTIONS, "k AS (SELECT symbol, least(CAST(floor(prob * 10) AS INT), 9) AS bin, count(*) AS n, avg(prob) AS p, avg(label) AS o FROM v GROUP BY 1, 2)", select="SELECT symbol, round(sum(n * abs(p - o)) / sum(n), 6) AS ece, round(max(abs(p - o)), 6) AS max_gap FROM k GROUP BY symbol")
plan("brier_log_loss", HOURS, PREDICTIONS, select="SELECT symbol, round(avg((prob - label) * (prob - label)), 6) AS brier, round(1 - avg((prob - label) * (prob - label)) / nullif(avg(label) * (1 - avg(label)), 0), 6) AS brier_skill, round(-avg(label * ln(greatest(least(prob, 1 - 1e-15), 1e-15)) + (1 - label) * ln(greatest(least(1 - prob, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM v GROUP BY symbol")
plan("calibration_table", HOURS, PREDICTIONS, "s AS (SELECT SEQ_[CAST(0 AS BIGINT); CAST(9 AS BIGINT)] AS bin)", "k AS (SELECT least(CAST(floor(prob * 10) AS INT), 9) AS bin, count(*) AS n, avg(prob) AS p, avg(label) AS o FROM v GROUP BY 1)", select="SELECT s.bin, coalesce(n, 0) AS n, round(p, 6) AS mean_prob, round(o, 6) AS observed FROM s LEFT JOIN k ON s.bin = k.bin")
plan("calibration_report", HOURS, PREDICTIONS, "k AS (SELECT least(CAST(floor(prob * 10) AS INT), 9) AS bin, avg(prob) AS p, avg(label) AS o FROM v GROUP BY 1)", select="SELECT round(avg(abs(p - o)), 6) AS mean_gap, round(regr_slope(o, p), 6) AS slope, round(max_by(o - p, bin), 6) AS last_gap, round(min_by(o - p, bin), 6) AS first_gap, count(*) AS n_bins FROM k")
plan("reliability_quantile", HOURS, PREDICTIONS, "e AS (SELECT PCT_[prob; 0.25] AS q1, PCT_[prob; 0.5] AS q2, PCT_[prob; 0.75] AS q3 FROM v)", select="SELECT CASE WHEN prob >= q3 THEN 3 WHEN prob >= q2 THEN 2 WHEN prob >= q1 THEN 1 ELSE 0 END AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(label), 6) AS observed FROM v CROSS JOIN e GROUP BY 1")
_REG = "count(*) AS n, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse, 1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0) AS r2, avg(CASE WHEN abs(y) >= 1e-6 THEN abs((y - pred) / y) END) AS mape"
plan("regression_metrics", HOURS, PREDICTIONS, select=f"SELECT symbol, model, n, {rounded('mae', 'rmse', 'r2', 'mape')} FROM (SELECT symbol, model, {_REG} FROM m GROUP BY symbol, model) t")
plan("direction_accuracy", HOURS, PREDICTIONS, select=f"SELECT symbol, model, count(*) AS n, round(avg(CASE WHEN sign(y) = sign(pred) AND pred <> 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round({wilson('sum(CASE WHEN sign(y) = sign(pred) AND pred <> 0 THEN 1.0 ELSE 0.0 END)', 'count(*)', -1)}, 6) AS wilson_lo, round({wilson('sum(CASE WHEN sign(y) = sign(pred) AND pred <> 0 THEN 1.0 ELSE 0.0 END)', 'count(*)', 1)}, 6) AS wilson_hi FROM m GROUP BY symbol, model")
plan("spearman_ic", HOURS, PREDICTIONS, f"r AS (SELECT symbol, model, {average_rank('y', 'symbol, model')} AS ry, {average_rank('pred', 'symbol, model')} AS rp FROM m WHERE model <> 'zero')", select="SELECT symbol, model, round(corr(ry, rp), 6) AS ic FROM r GROUP BY symbol, model")
_DEC = "dz AS (SELECT symbol, y, pred, row_number() OVER (PARTITION BY symbol ORDER BY pred, h) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM m WHERE model = 'momentum'), db AS (SELECT symbol, y, greatest(CAST(ceil((r - 1) * 10.0 / (n - 1)) AS INT), 1) - 1 AS decile FROM dz)"
plan("decile_ladder", HOURS, PREDICTIONS, _DEC, select="SELECT symbol, decile, count(*) AS n, round(avg(y), 6) AS mean_y, round(PCT_[y; 0.5], 6) AS median_y, round(stddev_samp(y), 6) AS std_y FROM db GROUP BY symbol, decile")
plan("long_short_spread", HOURS, PREDICTIONS, "z AS (SELECT symbol, model, y, row_number() OVER (PARTITION BY symbol, model ORDER BY pred, h) AS r, floor(count(*) OVER (PARTITION BY symbol, model) * 0.2) AS leg, count(*) OVER (PARTITION BY symbol, model) AS n FROM m)", select="SELECT symbol, model, round(avg(CASE WHEN r > n - leg THEN y END), 6) AS long_mean, round(avg(CASE WHEN r <= leg THEN y END), 6) AS short_mean, round(avg(CASE WHEN r > n - leg THEN y END) - avg(CASE WHEN r <= leg THEN y END), 6) AS spread FROM z GROUP BY symbol, model")
_MOM = "q AS (SELECT symbol, count(*) AS n, avg(y) AS mu, var_pop(y) AS v2 FROM v GROUP BY symbol), g AS (SELECT v.symbol, min(q.n) AS n, avg(power(y - mu, 3)) / power(min(v2), 1.5) AS g1, avg(power(y - mu, 4)) / power(min(v2), 2) - 3 AS g2 FROM v JOIN q ON v.symbol = q.symbol GROUP BY v.symbol)"
plan("return_distribution", HOURS, PREDICTIONS, select="SELECT symbol, count(*) AS n, round(avg(y), 6) AS mean_y, round(stddev_samp(y), 6) AS std_y, round(PCT_[y; 0.5], 6) AS median_y, round(PCT_[y; 0.05], 6) AS p05, round(PCT_[y; 0.25], 6) AS p25, round(PCT_[y; 0.75], 6) AS p75, round(PCT_[y; 0.95], 6) AS p95, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM v GROUP BY symbol")
plan("skew_kurtosis", HOURS, PREDICTIONS, _MOM, select="SELECT symbol, round(g1 * sqrt(n * (n - 1.0)) / (n - 2), 6) AS skew, round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6), 6) AS excess_kurtosis FROM g")
_HALF = "ha AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY h) AS i, count(*) OVER (PARTITION BY symbol, model) AS n FROM m)"
_CONF = "rs AS (SELECT symbol, model, abs(y - pred) AS e, row_number() OVER (PARTITION BY symbol, model ORDER BY abs(y - pred)) AS rk, count(*) OVER (PARTITION BY symbol, model) AS cnt FROM ha WHERE i * 2 <= n), cq AS (SELECT symbol, model, e AS q FROM rs WHERE rk = least(greatest(CAST(ceil(round((cnt + 1) * 0.9, 10)) AS BIGINT), 1), cnt))"
plan("conformal_quantile", HOURS, PREDICTIONS, _HALF, _CONF, select="SELECT symbol, model, round(q, 6) AS q FROM cq")
plan("conformal_coverage", HOURS, PREDICTIONS, _HALF, _CONF, select=f"SELECT t.symbol, t.model, count(*) AS n, round(avg(CASE WHEN abs(y - pred) <= q THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN abs(y - pred) <= q THEN 1.0 ELSE 0.0 END) - 0.9, 6) AS gap, round(2 * min(q), 6) AS width, round({wilson('sum(CASE WHEN abs(y - pred) <= q THEN 1.0 ELSE 0.0 END)', 'count(*)', -1)}, 6) AS wilson_lo, abs(avg(CASE WHEN abs(y - pred) <= q THEN 1.0 ELSE 0.0 END) - 0.9) <= 0.05 AS within_tolerance FROM ha t JOIN cq ON t.symbol = cq.symbol AND t.model = cq.model WHERE t.i * 2 > t.n GROUP BY t.symbol, t.model")
# rank of -pred among the residuals through one ordered union instead of comparing all pairs
plan("empirical_probability", HOURS, PREDICTIONS, _HALF, "un AS (SELECT symbol, model, h, -pred AS x, 1 AS side FROM ha WHERE i * 2 > n UNION ALL SELECT symbol, model, h, y - pred, 0 FROM ha WHERE i * 2 <= n)", "rk AS (SELECT *, sum(1 - side) OVER (PARTITION BY symbol, model ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below, sum(1 - side) OVER (PARTITION BY symbol, model) AS total FROM un)", select="SELECT symbol, model, h, round((total - below + 0.5) / (total + 1), 6) AS prob_positive FROM rk WHERE side = 1")

# --- regimes, comparisons, reports ---------------------------------------------------------------------------
_REGIME = f"rg AS (SELECT symbol, h, {roll('avg', 'close', 48, 12)} AS sma, close / {lag('close', 24)} - 1 AS r24, {roll('stddev_pop', 'lr', 24, 6)} AS vol, close FROM (SELECT *, CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END AS lr FROM c) c), rh AS (SELECT *, CASE WHEN count(vol) OVER {over(96)} >= 24 THEN PCT_[vol; 0.5] OVER {over(96)} END AS base FROM rg), ri AS (SELECT symbol, h, CASE WHEN sma IS NULL OR r24 IS NULL THEN 'unknown' WHEN close > sma AND r24 > 0.05 THEN 'bull' WHEN close < sma AND r24 < -0.05 THEN 'bear' ELSE 'sideways' END AS trend, CASE WHEN vol IS NULL OR base IS NULL THEN 'unknown' WHEN vol > base THEN 'high' ELSE 'low' END AS volatility FROM rh)"
plan("regime_labels", HOURS, _REGIME, select="SELECT symbol, h, trend, volatility FROM ri")
plan("regime_distribution", HOURS, _REGIME, select="SELECT symbol, trend, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol), 4) AS share_pct FROM ri GROUP BY symbol, trend")
plan("metrics_by_regime", HOURS, PREDICTIONS, _REGIME, select="SELECT ri.trend, m.model, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(sqrt(avg((y - pred) * (y - pred))), 6) END AS rmse, CASE WHEN count(*) >= 30 THEN round(avg(CASE WHEN sign(y) = sign(pred) AND pred <> 0 THEN 1.0 ELSE 0.0 END), 6) END AS hit_rate FROM m JOIN ri ON m.symbol = ri.symbol AND m.h = ri.h GROUP BY 1, 2")
plan("quantile_regimes", HOURS, PREDICTIONS, f"z AS (SELECT symbol, h, y, mom, {average_rank('abs(mom)', 'symbol')} / count(*) OVER (PARTITION BY symbol) AS pct FROM v)", select="SELECT symbol, CAST(greatest(ceil(round(pct * 3, 12)), 1) AS INT) - 1 AS regime, count(*) AS n, round(avg(abs(y)), 6) AS mean_abs_y FROM z GROUP BY 1, 2")
_MT = f"mt AS (SELECT symbol, model, {_REG} FROM m GROUP BY symbol, model)"
plan("best_model", HOURS, PREDICTIONS, _MT, select="SELECT symbol, model, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rmse, model) AS r FROM mt) t WHERE r = 1")
plan("compare_symbols", HOURS, PREDICTIONS, _MT, select="SELECT t.symbol, t.model, round(t.rmse, 6) AS rmse, round(1 - t.rmse / z.rmse, 6) AS skill, CAST(dense_rank() OVER (PARTITION BY t.model ORDER BY round(t.rmse, 9)) AS BIGINT) AS rank_ FROM mt t JOIN mt z ON t.symbol = z.symbol AND z.model = 'zero'")
plan("fold_metrics", HOURS, PREDICTIONS, "fo AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol, model ORDER BY h) - 1) * 4 / count(*) OVER (PARTITION BY symbol, model)) AS INT) AS fold FROM m)", "fm AS (SELECT model, symbol, fold, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM fo GROUP BY 1, 2, 3)", select="SELECT model, round(avg(rmse), 6) AS mean_rmse, round(PCT_[rmse; 0.5], 6) AS median_rmse, round(coalesce(stddev_samp(rmse), 0), 6) AS std_rmse, round(min(rmse), 6) AS min_rmse, round(max(rmse), 6) AS max_rmse, count(*) AS n FROM fm GROUP BY model")
plan("headline_winners", HOURS, PREDICTIONS, _MT, f"ic AS (SELECT symbol, model, corr(ry, rp) AS ic FROM (SELECT symbol, model, {average_rank('y', 'symbol, model')} AS ry, {average_rank('pred', 'symbol, model')} AS rp FROM m WHERE model <> 'zero') t GROUP BY symbol, model)", select="SELECT a.symbol, rmse_winner, best_rmse, ic_winner, best_ic FROM (SELECT symbol, min_by(model, rmse) AS rmse_winner, round(min(rmse), 6) AS best_rmse FROM mt GROUP BY symbol) a JOIN (SELECT symbol, max_by(model, ic) AS ic_winner, round(max(ic), 6) AS best_ic FROM ic GROUP BY symbol) b ON a.symbol = b.symbol")
plan("pooled_with_intervals", HOURS, PREDICTIONS, _HALF, _CONF, _MT, select="SELECT mt.symbol, mt.model, round(rmse, 6) AS rmse, round(2 * q, 6) AS width FROM mt LEFT JOIN cq ON mt.symbol = cq.symbol AND mt.model = cq.model AND mt.model <> 'zero'")
plan("feature_coverage", HOURS, f"z AS (SELECT symbol, {roll('avg', 'close', 50)} AS sma_50, {lag('close', 24)} AS lag_24, {roll('avg', 'close', 200)} AS sma_200 FROM c)", select=" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, count({f}) AS n_present, round(count({f}) * 100.0 / count(*), 4) AS coverage_pct FROM z" for f in ("sma_50", "lag_24", "sma_200")))
plan("symbol_profile", HOURS, _Y, select="SELECT symbol, count(*) AS n, count(fr) AS n_labelled, round(count(fr) * 100.0 / count(*), 4) AS retention_pct, CASE WHEN count(fr) < count(*) THEN 'no_label' ELSE 'none' END AS largest_drop FROM y GROUP BY symbol")
plan("baseline_models", HOURS, PREDICTIONS, _HALF, "tr AS (SELECT symbol, avg(y) AS mean_y, avg(CASE WHEN i > floor(n / 2) - 24 THEN y END) AS recent_mean FROM ha WHERE model = 'zero' AND i * 2 <= n GROUP BY symbol)", select="SELECT t.symbol, count(*) AS n, round(sqrt(avg(y * y)), 6) AS rmse_zero, round(sqrt(avg((y - mean_y) * (y - mean_y))), 6) AS rmse_mean, round(sqrt(avg((y - recent_mean) * (y - recent_mean))), 6) AS rmse_trailing FROM ha t JOIN tr ON t.symbol = tr.symbol WHERE t.model = 'zero' AND t.i * 2 > t.n GROUP BY t.symbol")

# --- strategies ----------------------------------------------------------------------------------------------
# a position earns the return of the hour after it; an opening is charged on its row, a closing one row later. Returns are scaled and cut, as the tables' prices jump
_RUNNING = "OVER (PARTITION BY symbol ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_STRAT = f"""po AS (SELECT symbol, h, CASE WHEN prob >= 0.55 THEN 1 WHEN prob <= 0.45 THEN -1 ELSE 0 END AS pos, {lead('r1')} AS nxt FROM v),
    ch AS (SELECT symbol, h, pos, greatest(least(nxt, 0.5), -0.5) * 0.01 AS target, pos - coalesce({lag('pos')}, 0) AS moved FROM po WHERE nxt IS NOT NULL),
    nt AS (SELECT symbol, h, pos, pos * target - (greatest(moved, 0) + greatest(-coalesce({lag('moved')}, 0), 0)) * 0.0005 AS net FROM ch),
    eq AS (SELECT symbol, h, pos, net, CASE WHEN sum(CASE WHEN net = -1 THEN 1 ELSE 0 END) {_RUNNING} > 0 THEN 0.0 ELSE (1 - 2 * (sum(CASE WHEN net < -1 THEN 1 ELSE 0 END) {_RUNNING} % 2)) * exp(sum(CASE WHEN net <> -1 THEN ln(abs(1 + net)) END) {_RUNNING}) END AS equity FROM nt),
    dd AS (SELECT *, equity / greatest(1.0, max(equity) {_RUNNING}) - 1 AS drawdown FROM eq)"""
plan("strategy_positions", HOURS, PREDICTIONS, _STRAT, select="SELECT symbol, h, pos FROM po")
plan("strategy_equity", HOURS, PREDICTIONS, _STRAT, select="SELECT symbol, h, round(net, 6) AS net, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM dd")
plan("strategy_statistics", HOURS, PREDICTIONS, _STRAT, select=f"SELECT symbol, count(*) AS n, round(max_by(equity, h) - 1, 6) AS total_return, round(min(drawdown), 6) AS max_drawdown, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(8760.0), 4) AS sharpe, round(avg(net) / nullif(sqrt(avg(CASE WHEN net < 0 THEN net * net ELSE 0.0 END)), 0) * sqrt(8760.0), 4) AS sortino, round(avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END), 6) AS exposure, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round({wilson('sum(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)', 'count(*)', 1)}, 6) AS hit_hi FROM dd GROUP BY symbol")
plan("strategy_sweep", HOURS, PREDICTIONS, "s2 AS (SELECT symbol, model, h, y, pred, CASE WHEN pred > 0 THEN 1 ELSE 0 END AS lo, CASE WHEN pred > 0 THEN 1 WHEN pred < 0 THEN -1 ELSE 0 END AS ls FROM m)", select=" UNION ALL ".join(f"SELECT model, '{k}' AS mode, count(*) AS n, round(avg({e} * y), 6) AS mean_return, round(avg(abs({e}) * 1.0), 6) AS exposure FROM s2 GROUP BY model" for k, e in (("long_only", "lo"), ("long_short", "ls"), ("always_long", "1"))))
plan("equity_fill", HOURS, "z AS (SELECT symbol, h, CASE WHEN h % 4 = 0 THEN close END AS e FROM c)", "k AS (SELECT *, count(e) OVER (PARTITION BY symbol ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM z)", "ff AS (SELECT symbol, h, e, max(e) OVER (PARTITION BY symbol, g) AS fwd, first_value(e) OVER (PARTITION BY symbol ORDER BY CASE WHEN e IS NULL THEN 1 ELSE 0 END, h) AS first_e FROM k)", select="SELECT symbol, h, round(coalesce(fwd, first_e), 6) AS filled FROM ff")
plan("importance_top_k", HOURS, PREDICTIONS, "f AS (SELECT 'mom' AS feature, abs(corr(mom, y)) AS gain FROM v UNION ALL SELECT 'r1', abs(corr(r1, y)) FROM v UNION ALL SELECT 'prob', abs(corr(prob, y)) FROM v)", select="SELECT feature, round(gain, 6) AS gain FROM f ORDER BY gain DESC, feature LIMIT 2")

# --- further comparisons -------------------------------------------------------------------------------------
_HALVES = "hf AS (SELECT symbol, h, y, prob, row_number() OVER (PARTITION BY symbol ORDER BY h) * 2 <= count(*) OVER (PARTITION BY symbol) AS early FROM v), tc AS (SELECT symbol, early, t / 10.0 AS threshold, avg(y) AS r, count(*) AS n FROM hf CROSS JOIN (SELECT SEQ_[CAST(5 AS BIGINT); CAST(8 AS BIGINT)] AS t) g WHERE prob >= t / 10.0 GROUP BY symbol, early, t / 10.0)"
plan("threshold_stability", HOURS, PREDICTIONS, _HALVES, "bt AS (SELECT symbol, early, threshold, row_number() OVER (PARTITION BY symbol, early ORDER BY r DESC, threshold) AS k FROM tc WHERE n >= 10)", select="SELECT a.symbol, round(a.threshold, 2) AS early_threshold, round(b.threshold, 2) AS late_threshold, abs(a.threshold - b.threshold) <= 0.04 AS stable FROM bt a JOIN bt b ON a.symbol = b.symbol AND a.early AND NOT b.early AND a.k = 1 AND b.k = 1")
plan("target_comparison", HOURS, f"y AS (SELECT symbol, h, {', '.join(f'{lead("close", k)} / close - 1 AS f{k}' for k in (1, 6, 24))} FROM c)", select=" UNION ALL ".join(f"SELECT 'h{k}_{t}' AS target, count(f{k}) AS n, round(avg(CASE WHEN f{k} >= 0.{t} THEN 1.0 WHEN f{k} IS NOT NULL THEN 0.0 END), 6) AS positive_share FROM y" for k, t in ((1, "05"), (6, "05"), (6, "10"), (24, "05"), (24, "20"))))
plan("per_asset_vs_global", HOURS, PREDICTIONS, _HALF, "own AS (SELECT symbol, avg(y) AS mu FROM ha WHERE model = 'zero' AND i * 2 <= n GROUP BY symbol)", "overall AS (SELECT avg(y) AS mu FROM ha WHERE model = 'zero' AND i * 2 <= n)", select="SELECT t.symbol, round(sqrt(avg((y - own.mu) * (y - own.mu))), 6) AS rmse_own, round(sqrt(avg((y - overall.mu) * (y - overall.mu))), 6) AS rmse_global FROM ha t JOIN own ON t.symbol = own.symbol CROSS JOIN overall WHERE t.model = 'zero' AND t.i * 2 > t.n GROUP BY t.symbol")
plan("buy_and_hold", HOURS, select="SELECT symbol, round(max_by(close, h) / min_by(open, h) - 1, 6) AS gross, round(max_by(close, h) / min_by(open, h) * 0.999 * 0.999 - 1, 6) AS net, round(min(close) / max(close) - 1, 6) AS worst_span, count(*) AS n_bars FROM c GROUP BY symbol")
plan("scalar_broadcast_median", HOURS, "md AS (SELECT symbol, PCT_[close; 0.5] AS m FROM c GROUP BY symbol)", select="SELECT c.symbol, c.h, round(c.close - md.m, 6) AS centred FROM c JOIN md ON c.symbol = md.symbol")
plan("model_table_pivot", HOURS, PREDICTIONS, _MT, select="SELECT symbol, round(max(CASE WHEN model = 'momentum' THEN rmse END), 6) AS momentum, round(max(CASE WHEN model = 'reversal' THEN rmse END), 6) AS reversal, round(max(CASE WHEN model = 'zero' THEN rmse END), 6) AS zero_ FROM mt GROUP BY symbol")
# experiments: two runs of each series from each of two starts; what they read is told by a digest of start, end, rows and symbol
plan("experiment_comparability", HOURS, "z AS (SELECT symbol, run, min(h) AS first_h, max(h) AS last_h, count(*) AS n FROM c CROSS JOIN (SELECT SEQ_[CAST(0 AS BIGINT); CAST(3 AS BIGINT)] AS run) r WHERE h >= (SELECT min(h) FROM c) + (run % 2) * 48 GROUP BY symbol, run)", "mf AS (SELECT *, md5(concat(symbol, '|', CAST(first_h AS STRING), '|', CAST(last_h AS STRING), '|', CAST(n AS STRING))) AS manifest FROM z)", select="SELECT manifest, count(*) AS n_experiments, count(DISTINCT first_h) AS n_starts, min(n) AS n_rows, count(*) > 1 AS comparable FROM mf GROUP BY manifest")
plan("drop_report", HOURS, "z AS (SELECT symbol, close > 0 AS priced, h % 50 <> 0 AS kept_grid, count(*) AS n FROM c GROUP BY 1, 2, 3)", select="SELECT symbol, CAST(sum(n) AS BIGINT) AS n_input, CAST(sum(CASE WHEN NOT priced THEN n ELSE 0 END) AS BIGINT) AS dropped_price, CAST(sum(CASE WHEN priced AND NOT kept_grid THEN n ELSE 0 END) AS BIGINT) AS dropped_grid, CAST(sum(CASE WHEN priced AND kept_grid THEN n ELSE 0 END) AS BIGINT) AS n_kept FROM z GROUP BY symbol")
plan("position_bars", HOURS, PREDICTIONS, _STRAT, "ru AS (SELECT symbol, h, pos, CASE WHEN pos = lag(pos) OVER (PARTITION BY symbol ORDER BY h) THEN 0 ELSE 1 END AS new FROM po)", "rn AS (SELECT symbol, h, pos, sum(new) OVER (PARTITION BY symbol ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ru)", select="SELECT symbol, pos, CAST(run AS BIGINT) AS run, min(h) AS from_h, max(h) AS to_h, count(*) AS bars FROM rn GROUP BY symbol, pos, run")
plan("shared_features", HOURS, f"w AS (SELECT symbol, {lag('close', 24)} AS lag_24, {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'close', 650)} AS sma_650 FROM c)", "z AS (SELECT symbol, count(lag_24) AS a, count(sma_50) AS b, count(sma_650) AS d FROM w GROUP BY symbol)", select="SELECT 'lag_24' AS feature, min(a) > 0 AS shared FROM z UNION ALL SELECT 'sma_50', min(b) > 0 FROM z UNION ALL SELECT 'sma_650', min(d) > 0 FROM z")
