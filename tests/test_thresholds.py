"""Thresholds by backtest against backtests of one threshold, and the rules of choice."""

import random

import pytest

from tidelane.functions.portable import spark as in_spark
from tidelane.operators import backtest, recurrences, thresholds


def bars(spark, n, seed=3):
    rng = random.Random(seed)
    price, rows = 100.0, []
    for h in range(n):
        opened = price
        price *= 1 + rng.gauss(0, 0.01)
        rows.append(("x", h, opened, price, rng.random()))
    return spark.createDataFrame(rows, "symbol string, h long, open double, close double, prob double").coalesce(1)


def alone(spark, b, percent):
    ledger = backtest.priced(recurrences.trades(b, threshold=percent / 100, hold=3))
    e = backtest.equity(b, ledger)
    c, t = spark.sql(in_spark(backtest.constants(backtest.CURVE)), e=e), spark.sql(in_spark(backtest.LEDGER), t=ledger)
    return spark.sql(in_spark(backtest.constants(backtest.REPORT)), c=c, l=t).first()


def test_curve_is_one_backtest_for_each_threshold(spark):
    b = bars(spark, 80)
    got = {r.percent: r for r in thresholds.curve(b, (40, 101), hold=3).collect()}
    assert set(got) == {40, 101} and got[101].n_trades == 0 and got[101].win_rate is None
    want = alone(spark, b, 40)
    assert got[40].n_trades == want.n_trades > 5
    for name in ("total_return", "excess_vs_buy_hold", "max_drawdown", "time_in_market"):
        assert got[40][name] == pytest.approx(want[name])


def test_choice_needs_trades_and_halves_are_rated_by_themselves(spark):
    b = bars(spark, 420)
    chosen = thresholds.select(b, (40, 90), least=30, hold=3).first()
    rated = {p: alone(spark, b, p) for p in (40, 90)}
    best = max((p for p in rated if rated[p].n_trades >= 30), key=lambda p: (rated[p].excess_vs_buy_hold, -p))
    assert chosen.threshold == pytest.approx(best / 100) and chosen.enough_trades and chosen.compared
    halves = []
    for part in (b.where("h < 210"), b.where("h >= 210")):
        r = {p: alone(spark, part, p) for p in (40, 90)}
        halves.append(max((p for p in r if r[p].n_trades >= 10), key=lambda p: (r[p].excess_vs_buy_hold, -p)))
    assert [chosen.first_half, chosen.second_half] == pytest.approx([p / 100 for p in halves])
    assert chosen.agrees == (halves[0] == halves[1])


def test_without_enough_trades_the_most_active_threshold_is_taken(spark):
    got = thresholds.select(bars(spark, 40), (60, 40, 95), least=30, hold=3).first()
    assert (float(got.threshold), got.enough_trades, got.compared, got.agrees) == (0.4, False, False, None)
    assert thresholds.select(bars(spark, 0), (40,)).isEmpty()
