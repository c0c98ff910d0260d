"""Operators on small hand-made series, and every plan against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelane.functions.portable import roll, wilson, zscore
from tidelane.functions.portable import spark as in_spark
from tidelane.operators import asof, backtest, features, recurrences
from tidelane.plans import registry
from tidelane.sources import paged, sinks
from tidelane.sources.candles import hourly

SF = "/root/testdata/sf0.001"
ROWS_ONLY = [n for n in registry.QUERIES if n not in registry.ORACLE_SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_plan_equals_duckdb(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def candles(spark, closes, symbol="x", start=0):
    return spark.createDataFrame([(symbol, start + i, c, c + 1, c - 1, c, 10.0 + i, 5) for i, c in enumerate(map(float, closes))], "symbol string, h long, open double, high double, low double, close double, volume double, trades long")


def test_rolling_counts_values_and_zscore_leaves_out_the_row(spark):
    c = candles(spark, [1, 2, 4, 8]).withColumn("close", F.when(F.col("h") != 1, F.col("close")))
    got = c.selectExpr("h", in_spark(f"{roll('avg', 'close', 3, 2)} AS m"), in_spark(f"{zscore('close', 2, 2)} AS z")).orderBy("h").collect()
    assert [r.m for r in got] == [None, None, 2.5, 6.0]
    assert [r.z for r in got] == [None, None, None, None]


def test_features_do_not_see_the_future(spark):
    layers = [{n: in_spark(e) for n, e in layer.items()} for layer in features.technical(sma=(3, 5), volatility=(4,), band=4, volume=4, roc=2)]
    closes = [10 + math.sin(i) * 3 + i / 7 for i in range(40)]
    whole = {r.h: r.asDict() for r in features.add(candles(spark, closes), layers).collect()}
    part = {r.h: r.asDict() for r in features.add(candles(spark, closes[:25]), layers).collect()}
    assert all(part[h] == whole[h] for h in part)


def test_asof_keeps_nulls_of_the_newest_row_and_ages_out(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 5, 9, 30)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 6, None), ("a", 6, None), ("b", 2, 9.0)], "k string, u long, v double")
    for width in (None, 7):
        got = {r.t: (r.v, r.source_time) for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"], max_age=10, slice_width=width).collect()}
        assert got == {0: (None, None), 5: (1.0, 1), 9: (None, 6), 30: (None, 6)}
    joined = asof.asof_join(left, right, ["k"], "t", "u", ["v"], max_age=10)
    assert list(asof.audit(joined, "t", ["v"], 10).first()) == [0, 0, 0]


def test_asof_of_empty_sides(spark):
    left = spark.createDataFrame([], "k string, t long")
    right = spark.createDataFrame([], "k string, u long, v double")
    assert asof.asof_join(left, right, ["k"], "t", "u", ["v"]).count() == 0
    one = spark.createDataFrame([("a", 1)], "k string, t long")
    assert asof.asof_join(one, right, ["k"], "t", "u", ["v"]).first().v is None


def test_oscillators_match_pandas(spark):
    closes = [10 + math.sin(i) * 3 for i in range(60)]
    got = recurrences.oscillators(candles(spark, closes)).orderBy("h").toPandas()
    s = pd.Series(closes)
    ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
    macd = ema(s, 12) - ema(s, 26)
    assert (got.ema_fast - ema(s, 12)).abs().max() < 1e-9
    assert (got.macd_signal - ema(macd, 9)).abs().max() < 1e-9
    assert got.rsi.iloc[0] is None or math.isnan(got.rsi.iloc[0])
    assert got.rsi.iloc[1:].between(0, 100).all()


def test_entries_and_trades(spark):
    c = candles(spark, range(1, 13))
    assert [r.h for r in recurrences.entries(c, 5).orderBy("h").collect()] == [0, 5, 10]
    t = recurrences.trades(c.withColumn("prob", F.lit(0.9)), hold=3, cost=0.0, slip=0.0).orderBy("entry_h").collect()
    assert [(r.entry_h, r.exit_h) for r in t] == [(1, 3), (5, 7), (9, 11)]
    assert t[0].gross == pytest.approx(4 / 2 - 1)
    assert recurrences.trades(c.withColumn("prob", F.lit(0.1))).count() == 0
    falling = c.withColumn("prob", F.when(F.col("h") == 3, 0.2).otherwise(0.9))
    assert [(r.entry_h, r.exit_h, r.early) for r in recurrences.trades(falling, hold=5, exit_below=0.5).orderBy("entry_h").collect()] == [(1, 3, True), (5, 9, False), (11, 11, False)]


def test_equity_of_one_trade(spark):
    c = candles(spark, [10, 10, 20, 40, 5, 5]).withColumn("prob", F.when(F.col("h") == 0, 0.9).otherwise(0.1))
    ledger = backtest.priced(recurrences.trades(c, hold=3, cost=0.0, slip=0.0), capital=100.0, cost=0.0)
    e = backtest.equity(c, ledger, capital=100.0).orderBy("h").collect()
    assert [round(r.equity, 6) for r in e] == [100, 100, 200, 400, 400, 400]
    assert [r.in_position for r in e] == [False, True, True, True, False, False]
    none = backtest.equity(c, ledger.where("false"), capital=100.0).collect()
    assert {(r.equity, r.in_position) for r in none} == {(100.0, False)}


def test_wilson_is_within_bounds(spark):
    lo, hi = spark.range(1).selectExpr(in_spark(wilson("10.0", "10", -1)), in_spark(wilson("10.0", "10", 1))).first()
    assert 0.7 < lo < 0.73 and hi == 1.0


def test_candles_from_events_with_clashing_columns(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("open", F.lit("x")).withColumn("h", F.lit(None).cast("int"))
    assert hourly(e).agg(F.sum("trades")).first()[0] == e.count()


def test_paged_source_walks_forward_and_retries(spark):
    bars = [[i * 3_600_000, "1", "2", "0.5", "1.5", "10", 0, "15", 3, "5", "7", "0"] for i in range(25)]
    calls = []

    def transport(start, limit):
        calls.append(start)
        if len(calls) == 2:
            raise ConnectionError("try again")
        return [b for b in bars if b[0] >= start][:limit]

    got = list(paged.pages(transport, 0, 3_600_000, limit=10, sleep=lambda s: None))
    assert [len(p) for p in got] == [10, 10, 5] and len(calls) == 4
    table = paged.parse(spark, [r for p in got for r in p])
    assert table.count() == 25 and table.schema["trades"].dataType.simpleString() == "bigint"


def test_versioned_write_switches_atomically(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write_version(spark.range(3), path)
    sinks.write_version(spark.range(5), path)
    assert sinks.read_version(spark, path).count() == 5
    assert sinks.strict_json(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()[0] == '{"b":1}'


def test_queries_without_sql_return_rows(spark):
    for name in ("bootstrap_sharpe", "model_walk_forward"):
        assert name in ROWS_ONLY
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registration_hold_together():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def run_layers(spark, rows, ddl, layers):
    return features.add(spark.createDataFrame(rows, ddl), [{n: in_spark(e) for n, e in layer.items()} for layer in layers]).orderBy("h")


def test_streak_goes_on_over_gaps(spark):
    rates = [0.1, 0.2, None, 0.3, -0.1, None, 0.2, -0.3]
    rows = [("x", i, 100.0, 1.0, 1, r, 101.0, 1.0, 1, 0.5) for i, r in enumerate(rates)]
    ddl = "symbol string, h long, close double, volume double, trades long, funding_rate double, futures_price double, futures_volume double, futures_trades long, futures_taker_buy double"
    got = [r.funding_streak for r in run_layers(spark, rows, ddl, features.derivatives()).collect()]
    # a change of sign beside a gap starts no run; rows without a rate are counted but have no streak
    assert got == [1, 2, None, 4, -1, None, 3, -1]


def simulated(spark, probs, rates):
    """net and equity of the strategy plans over a hand-made prediction table."""
    from tidelane.plans.catalog import _STRAT

    v = spark.createDataFrame([("x", i, p, r) for i, (p, r) in enumerate(zip(probs, rates, strict=True))], "symbol string, h long, prob double, r1 double")
    return [(r.net, r.equity) for r in spark.sql(in_spark(f"WITH v AS (SELECT * FROM {{v}}), {_STRAT} SELECT h, net, equity FROM dd ORDER BY h"), v=v).collect()]


def test_closing_is_charged_a_row_later(spark):
    got = simulated(spark, [0.9, 0.9, 0.5, 0.5, 0.1, 0.9], [0.0, 0.2, -0.1, 0.3, 0.1, 0.4])
    # positions 1, 1, 0, 0, -1: opened at 0, closed at 2 (charged at 3), sold at 4 (a closing, charged after the end)
    want = [0.002 - 0.0005, -0.001, 0.0, -0.0005, -0.004]
    assert [n for n, _ in got] == pytest.approx(want)
    equity = 1.0
    for (_, e), n in zip(got, want, strict=True):
        equity *= 1 + n
        assert e == pytest.approx(equity)
