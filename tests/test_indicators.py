from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.functions.columns import rolling
from factorspark.operators import indicators

DAYS = [date(2026, 1, 1) + timedelta(days=i) for i in range(120)]


def closes(spark, values, symbol="A"):
    return spark.createDataFrame(
        [(symbol, DAYS[i], v) for i, v in enumerate(values)], "symbol string, trade_date date, adj_close double"
    )


def test_forward_adjusted_prices(spark):
    rows = spark.createDataFrame(
        [("A", DAYS[0], 9.0, 10.0, 1.0), ("A", DAYS[1], 10.0, 20.0, 2.0), ("B", DAYS[0], 5.0, 5.5, None)],
        "symbol string, trade_date date, open double, close double, adj_factor double",
    )
    got = {(r.symbol, r.trade_date): (r.adj_close, r.adj_open) for r in indicators.adjust_prices(rows).collect()}
    assert got == {("A", DAYS[0]): (5.0, 4.5), ("A", DAYS[1]): (20.0, 10.0), ("B", DAYS[0]): (5.5, 5.0)}


def test_adjustment_without_factor_or_open(spark):
    rows = spark.createDataFrame([("A", DAYS[0], 10.0)], "symbol string, trade_date date, close double")
    row = indicators.adjust_prices(rows).first()
    assert (row.adj_close, row.adj_open) == (10.0, 10.0)


def test_zero_latest_factor_leaves_prices_alone(spark):
    rows = spark.createDataFrame(
        [("A", DAYS[0], 10.0, 2.0), ("A", DAYS[1], 11.0, 0.0)],
        "symbol string, trade_date date, close double, adj_factor double",
    )
    assert [r.adj_close for r in indicators.adjust_prices(rows).orderBy("trade_date").collect()] == [10.0, 11.0]


def test_flat_prices_have_no_cross_until_they_rise(spark):
    got = indicators.with_macd(closes(spark, [10.0] * 39 + [20.0])).orderBy("trade_date").collect()
    assert [i for i, r in enumerate(got) if r.macd_golden_cross] == [39]
    assert all(r.dif == 0.0 and r.dea == 0.0 for r in got[:39])


def test_flat_after_a_move_stays_exact(spark):
    values = [10.0, 11.7, 9.3] + [10.1] * 110
    got = indicators.with_macd(closes(spark, values)).orderBy("trade_date").collect()
    expected = brute_ema(values, 12)
    assert np.allclose([r.ema12 for r in got], expected, rtol=1e-12)


def brute_ema(values, span):
    alpha, out, weighted, weight = 2 / (span + 1), [], None, 1.0
    for value in values:
        if weighted is not None:
            weight *= 1 - alpha
        if value is None:
            out.append(None)
            continue
        if weighted is None:
            weighted = value
        else:
            weighted = (weight * weighted + alpha * value) / (weight + alpha)
        weight = 1.0
        out.append(weighted)
    return out


def test_ema_keeps_gaps_and_ages_over_them(spark):
    values = [10.0, None, 12.0, 13.0, None, None, 9.0, 10.0]
    got = indicators.with_macd(closes(spark, values)).orderBy("trade_date").collect()
    expected = brute_ema(values, 12)
    assert [r.ema12 is None for r in got] == [v is None for v in values]
    assert [r.ema12 for r in got if r.ema12 is not None] == pytest.approx([v for v in expected if v is not None])


def test_macd_of_many_symbols_matches_recursion(spark):
    generator = np.random.default_rng(7)
    frames, expected = None, {}
    for symbol in "ABCDE":
        values = list(100 + generator.normal(size=60).cumsum())
        part = closes(spark, [float(v) for v in values], symbol)
        frames = part if frames is None else frames.union(part)
        fast, slow = np.array(brute_ema(values, 12)), np.array(brute_ema(values, 26))
        dif = fast - slow
        dea = np.array(brute_ema(list(dif), 9))
        expected[symbol] = [False] + [bool(dif[i - 1] <= dea[i - 1] and dif[i] > dea[i]) for i in range(1, 60)]
    got = indicators.with_macd(frames.repartition(5)).orderBy("symbol", "trade_date").toPandas()
    for symbol, rows in got.groupby("symbol"):
        assert [bool(v) if v is not None else False for v in rows.macd_golden_cross] == expected[symbol]


def test_rolling_needs_a_full_window_of_values(spark):
    rows = spark.createDataFrame(
        [("A", DAYS[i], v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])],
        "symbol string, trade_date date, x double",
    )
    got = rows.select("trade_date", rolling(F.avg, F.col("x"), 3).alias("m")).orderBy("trade_date").collect()
    assert [r.m for r in got] == [None, None, None, None, None, 5.0]


def test_price_indicators_against_pandas(spark):
    generator = np.random.default_rng(3)
    close, amount = 50 + generator.normal(size=100).cumsum() * 0.5, 1e5 + generator.random(100) * 1e4
    rows = spark.createDataFrame(
        [("A", DAYS[i], float(close[i]), float(amount[i])) for i in range(100)],
        "symbol string, trade_date date, adj_close double, amount double",
    )
    got = indicators.price_indicators(rows).orderBy("trade_date").toPandas()
    c, a = pd.Series(close), pd.Series(amount)
    daily = c / c.shift(1) - 1
    expected = {
        "daily_return": daily, "mom_20": c / c.shift(20) - 1, "mom_60": c / c.shift(60) - 1,
        "ma_strength": c / c.rolling(20).mean() - 1, "avg_amount_20": a.rolling(20).mean(),
        "turnover_stability": a.rolling(20).std() / a.rolling(20).mean(), "vol_20": daily.rolling(20).std(),
        "downside_vol_20": daily.where(daily < 0).rolling(20).std(), "max_drawdown_60": c / c.rolling(60).max() - 1,
    }
    for name, values in expected.items():
        assert np.allclose(got[name].astype(float), values, equal_nan=True), name


def test_flow_indicators_against_pandas(spark):
    generator = np.random.default_rng(4)
    rate, winner = generator.normal(size=40), 50 + generator.random(40) * 40
    rows = spark.createDataFrame(
        [("A", DAYS[i], float(rate[i]), float(winner[i])) for i in range(40)],
        "symbol string, trade_date date, main_net_inflow_rate double, close_profit_ratio double",
    )
    got = indicators.flow_indicators(rows).orderBy("trade_date").toPandas()
    r, w = pd.Series(rate), pd.Series(winner)
    expected = {
        "flow_5d": r.rolling(5).sum(), "flow_20d": r.rolling(20).sum(),
        "flow_persistence": (r > 0).astype(float).rolling(10).mean(),
        "winner_rate_change_5d": w - w.shift(5), "winner_rate_change_20d": w - w.shift(20),
    }
    for name, values in expected.items():
        assert np.allclose(got[name].astype(float), values, equal_nan=True), name


def test_period_return_spans_one_interval_less_than_rows(spark):
    rows = spark.createDataFrame(
        [("I", DAYS[i], 100.0 + i) for i in range(6)], "symbol string, trade_date date, close double"
    )
    got = [r.period_return for r in indicators.period_return(rows, 5).orderBy("trade_date").collect()]
    assert got[0] is None and got[1] == pytest.approx(1.0)
    assert got[5] == pytest.approx((105 / 101 - 1) * 100)
