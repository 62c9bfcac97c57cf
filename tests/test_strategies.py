import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.operators import evaluation, factors, indicators, pools, portfolio, ranking, signals, trades
from factorspark.plans import research

LAST = date(2025, 11, 14)
FLOW = "symbol string, trade_date date, main_net_inflow_rate double, close_profit_ratio double"


def calendar(length):
    return [LAST - timedelta(days=back) for back in reversed(range(length))]


def signal_inputs(spark, names=(("688111.SH", "Own One"),)):
    """Prices sink for 29 days and leap on the last: the fast average crosses the slow one there."""
    days = calendar(30)
    closes = [50.0 - 0.3 * i for i in range(29)] + [60.0]
    prices = [(s, d, c, 700.0) for s, _ in names for d, c in zip(days, closes)]
    return research.Inputs(
        spark.createDataFrame(prices, "symbol string, trade_date date, close double, amount double"),
        spark.createDataFrame([(s, LAST, 1.25, 91.5) for s, _ in names], FLOW),
        spark.createDataFrame([(s, n, "active") for s, n in names], "symbol string, name string, status string"),
        spark.createDataFrame([(d,) for d in days], "trade_date date"),
    )


def test_rank_001_keeps_the_signal_of_the_last_date(spark):
    rows = research.rank_candidate_001(signal_inputs(spark)).collect()
    assert [(r["rank"], r.symbol, r.signal_date) for r in rows] == [(1, "688111.SH", LAST)]
    assert rows[0].reason == "net_amount_rate>0; MACD golden cross; winner_rate=91.5"
    assert rows[0].recommend_trade_date is None


def test_rank_001_drops_special_treatment_names(spark):
    names = (("300999.SZ", "*ST Two"), ("688111.SH", "Own One"), ("600001.SH", "ST Three"))
    assert [r.symbol for r in research.rank_candidate_001(signal_inputs(spark, names)).collect()] == ["688111.SH"]


def test_pass_table_and_explanation(spark):
    data = signal_inputs(spark)
    rows = signals.candidates(data.prices, data.flow, data.security)
    successors = signals.date_successors(data.calendar)
    passed = signals.pass_table(rows, successors).first()
    assert passed.factor_rank == 1 and passed.factor_pass and passed.pass_macd_golden_cross
    assert passed.factor_value == (
        # 60 against 47.3 twenty rows earlier
        "main_net_inflow_rate=1.25; macd_golden_cross=true; close_profit_ratio=91.5; return_20d=0.268499"
    )


def test_order_puts_missing_returns_first(spark):
    rows = spark.createDataFrame(
        [("A", LAST, 1.0, 90.0, 0.5), ("B", LAST, 1.0, 90.0, None), ("C", LAST, 2.0, 81.0, 0.1), ("D", LAST, 1.0, 95.0, 0.0)],
        "symbol string, trade_date date, main_net_inflow_rate double, close_profit_ratio double, return_20d double",
    ).withColumns({"name": F.lit("n"), "close": F.lit(1.0), "macd_golden_cross": F.lit(True)})
    successors = signals.date_successors(rows)
    ranked = signals.ranking(rows, successors, 10).orderBy("rank").collect()
    assert [r.symbol for r in ranked] == ["C", "D", "B", "A"]
    table = signals.pass_table(rows, successors).orderBy("factor_rank").collect()
    assert [r.symbol for r in table] == ["C", "D", "B", "A"]


def backtest_inputs(spark):
    """A signal on the 21st day; bought at 50 the day after, 54 three days later. The benchmark gains 1.5 % in that time."""
    days = calendar(30)
    stock = [40.0 - 0.5 * i for i in range(20)] + [48.0, 50.0, 51.0, 49.0, 54.0, 55.0, 53.0, 53.0, 52.0, 50.0]
    index = [200.0] * 22 + [201.0, 202.0, 203.0] + [199.0] * 5
    prices = [("688111.SH", d, c, 700.0) for d, c in zip(days, stock)] + [("000852.SH", d, c, 700.0) for d, c in zip(days, index)]
    return research.Inputs(
        spark.createDataFrame(prices, "symbol string, trade_date date, close double, amount double"),
        spark.createDataFrame([("688111.SH", days[20], 1.25, 91.5)], FLOW),
        spark.createDataFrame([("688111.SH", "Own One", "active")], "symbol string, name string, status string"),
        spark.createDataFrame([(d,) for d in days], "trade_date date"),
    )


def test_backtest_001(spark):
    row = research.metrics_row(research.backtest_candidate_001(backtest_inputs(spark), holding_days=3)).first()
    assert (row.trade_count, row.signal_dates, row.missing_dates) == (1, 1, 0)
    assert row.avg_forward_return == pytest.approx(0.08) and row.best_trade_return == pytest.approx(0.08)
    assert row.benchmark_symbol == "000852.SH" and row.benchmark_return == pytest.approx(0.015)
    # one trade: nothing to spread, nothing to turn over
    assert row.return_std is None and row.annual_volatility == 0.0 and row.sharpe_ratio is None
    assert row.tracking_error == 0.0 and row.information_ratio is None
    assert row.turnover_proxy is None and row.holding_overlap is None


def test_unknown_benchmark_gives_nulls_and_counts_missing_dates(spark):
    result = research.backtest_candidate_001(backtest_inputs(spark), holding_days=5, benchmark_symbol="999999.SH")
    row = result.benchmarks.first()
    assert row.missing_dates == 1 and row.benchmark_return is None and row.tracking_error is None


def test_holding_days_must_be_positive(spark):
    with pytest.raises(ValueError):
        trades.entry_exit(backtest_inputs(spark).prices, 0)


def test_rows_without_exit_still_take_a_place(spark):
    days = [LAST + timedelta(days=i) for i in range(3)]
    prices = spark.createDataFrame(
        [("A", days[0], 1.0)] + [("B", d, 2.0) for d in days], "symbol string, trade_date date, close double"
    )
    rows = spark.createDataFrame(
        [("A", days[0], 9.0, 90.0, 0.1), ("B", days[0], 1.0, 90.0, 0.1)],
        "symbol string, trade_date date, main_net_inflow_rate double, close_profit_ratio double, return_20d double",
    )
    assert trades.signal_trades(rows, prices, 1, 1).count() == 0
    assert [r.symbol for r in trades.signal_trades(rows, prices, 1, 2).collect()] == ["B"]


def brute_metrics(returns, per_year):
    total = equity = peak = 1.0
    worst = 0.0
    for value in returns:
        total *= 1 + value
        equity *= 1 + value
        peak = max(peak, equity)
        worst = min(worst, equity / peak - 1)
    mean = sum(returns) / len(returns)
    deviation = (sum((v - mean) ** 2 for v in returns) / (len(returns) - 1)) ** 0.5
    annual = total ** (per_year / len(returns)) - 1
    return total - 1, annual, deviation * per_year**0.5, worst


def test_portfolio_statistics_against_brute_force(spark):
    returns = [0.03, -0.05, 0.01, -0.02, 0.04, 0.0, -0.01]
    held = [{"A", "B"}, {"B", "C"}, {"B", "C"}, {"D"}, {"D", "A", "B"}, {"A"}, {"A", "C"}]
    rows = [
        (s, date(2025, 9, 28) + timedelta(days=i), r) for i, (r, h) in enumerate(zip(returns, held)) for s in sorted(h)
    ]
    made = spark.createDataFrame(rows, "symbol string, trade_date date, forward_return double")
    series = portfolio.portfolio_returns(made)
    total, annual, volatility, worst = brute_metrics(returns, 252 / 5)
    row = portfolio.return_metrics(series, 5).first()
    assert row.total_return == pytest.approx(total) and row.annual_return == pytest.approx(annual)
    assert row.annual_volatility == pytest.approx(volatility) and row.max_drawdown == pytest.approx(worst)
    assert row.sharpe_ratio == pytest.approx(annual / volatility) and row.calmar_ratio == pytest.approx(annual / abs(worst))
    moved = portfolio.turnover(series).first()
    pairs = list(zip(held, held[1:]))
    assert moved.turnover_proxy == pytest.approx(sum(1 - len(a & b) / len(b) for a, b in pairs) / len(pairs))
    assert moved.holding_overlap == pytest.approx(sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs))
    monthly = {r.month: r.monthly_return for r in portfolio.monthly_returns(series).collect()}
    assert monthly["2025-09"] == pytest.approx(1.03 * 0.95 * 1.01 - 1)


def test_total_loss_gives_minus_one(spark):
    made = spark.createDataFrame(
        [("A", LAST, -1.0), ("A", LAST + timedelta(days=1), 0.5)], "symbol string, trade_date date, forward_return double"
    )
    row = portfolio.return_metrics(portfolio.portfolio_returns(made), 5).first()
    assert row.annual_return == -1.0 and row.max_drawdown == -1.0


def test_benchmark_list_is_ordered_and_distinct():
    assert portfolio.benchmark_list(None) == ["000852.SH"]
    assert portfolio.benchmark_list(["b", "", "a", "b"]) == ["b", "a"]


def test_sweep_equals_single_backtests(spark):
    data = backtest_inputs(spark)
    rows = signals.candidates(data.prices, data.flow, data.security)
    priced = data.prices.withColumn("open", F.lit(None).cast("double"))
    got = {(r.holding_days, r.top): r.total_return for r in portfolio.sweep(rows, priced, [1, 5], [1, 3]).collect()}
    for days in (1, 5):
        alone = portfolio.return_metrics(
            portfolio.portfolio_returns(trades.signal_trades(rows, priced, days, 1)), days
        ).first()
        assert got[(days, 1)] == got[(days, 3)] == pytest.approx(alone.total_return)


# --- strategy 002 ---------------------------------------------------------------

A, B, C = "688111.SH", "300999.SZ", "600001.SH"
START, END = date(2025, 8, 1), date(2025, 8, 20)


@pytest.fixture(scope="module")
def factor_inputs(spark):
    """Random walks of three securities over 80 days to END: A is plain, B halted on the last day, C under special treatment."""
    rng = np.random.default_rng(17)
    days = [END - timedelta(days=back) for back in reversed(range(80))]
    prices, flows = [], []
    for symbol, traded, inflow in ((A, 90_000.0, 3.0), (B, 80_000.0, 2.0), (C, 60_000.0, 1.0)):
        walk = (30 * np.cumprod(1 + rng.normal(0.002, 0.02, len(days)))).round(3).tolist()
        for place, (day, close) in enumerate(zip(days, walk)):
            split = 2.0 if symbol == B and place >= 40 else 1.0
            prices.append((symbol, day, "stock", close - 0.01, close, traded + place, 2.0, split, symbol == B and day == END, 2 * close, close / 2))
            flows.append((symbol, day, inflow, 86.0))
    for symbol in ("000852.SH", "399006.SZ"):
        level = (1000 * np.cumprod(1 + rng.normal(0, 0.01, len(days)))).round(2).tolist()
        prices += [(symbol, day, "index", v, v, 1.0, None, None, None, None, None) for day, v in zip(days, level)]
    listed = [(A, "Own One", "active", "star", "计算机", date(2019, 1, 7)), (B, "Own Two", "active", "chinext", "汽车", date(2010, 6, 1)),
              (C, "*ST Three", "active", "sh_main", "煤炭", date(1999, 3, 3))]
    return research.Inputs(
        spark.createDataFrame(
            prices,
            "symbol string, trade_date date, asset_type string, open double, close double, amount double, turnover_rate double, "
            "adj_factor double, is_suspended boolean, limit_up double, limit_down double",
        ),
        spark.createDataFrame(flows, FLOW),
        spark.createDataFrame(listed, "symbol string, name string, status string, market_segment string, industry string, list_date date"),
        spark.createDataFrame([(d,) for d in days], "trade_date date"),
    )


@pytest.fixture(scope="module")
def factor_run(spark, factor_inputs, tmp_path_factory):
    from factorspark.plans.promotion import Workspace
    from factorspark.sources import artifacts

    ws = Workspace(spark, str(tmp_path_factory.mktemp("runs")))
    research.compute_daily_factors(ws, factor_inputs, str(START), str(END), "factor_002_test", "snapshot_x")
    return ws, artifacts.read_factor_run(spark, ws.root, "factor_002_test")


def test_factor_run_excludes_st_and_suspended(factor_run):
    _, run = factor_run
    reasons = {(r.symbol, r.trade_date): r.exclusion_reason for r in run.collect()}
    assert {k[0] for k in reasons} == {A, B, C}
    assert all(v == "st_security" for k, v in reasons.items() if k[0] == C)
    assert reasons[B, END] == "suspended" and reasons[B, START] == "none"
    assert run.agg(F.min("trade_date")).first()[0] == START


def test_scores_of_the_last_date(factor_run):
    _, run = factor_run
    row = run.filter((F.col("symbol") == A) & (F.col("trade_date") == F.lit(END))).first()
    # most inflow of three; all three had inflows on each of the last days, so they share the middle rank there
    assert row.flow_score == pytest.approx(0.4 + 0.3 + 0.3 * 2 / 3)
    assert row.chip_score == pytest.approx(0.8)
    total = (row.momentum_score * 0.3 + row.flow_score * 0.25 + row.chip_score * 0.15 + row.risk_score * 0.15
             + row.liquidity_score * 0.15)
    assert row.total_score == pytest.approx(total)


def test_scores_do_not_depend_on_the_parts(factor_inputs, monkeypatch):
    assembled = factors.assemble(factor_inputs.prices, factor_inputs.flow, factor_inputs.security, "2025-08-10", "2025-08-20")
    found = []
    for rows in (7, 250_000):
        monkeypatch.setattr(ranking, "PART_ROWS", rows)
        found.append(factors.score(assembled).orderBy("symbol", "trade_date").toPandas())
    for name in ("momentum_score", "flow_score", "risk_score", "liquidity_score", "total_score"):
        assert found[0][name].tolist() == pytest.approx(found[1][name].tolist())


def test_assembly_exchanges_each_input_once(spark, factor_inputs):
    """Without broadcasts: three exchanges by symbol, none for the joins or the exponential average, whose rows Python sees narrow."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = factors.assemble(factor_inputs.prices, factor_inputs.flow, factor_inputs.security)
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3 and all("hashpartitioning(symbol" in e for e in exchanges)
    assert plan.count("ArrowEvalPython") == 1 and "FlatMapGroups" not in plan


def test_averages_do_not_depend_on_the_batches(spark, factor_inputs):
    """Symbols that span Arrow batches against pandas, with a gap in the prices."""
    import pandas as pd

    prices = factor_inputs.prices.filter("asset_type = 'stock'").withColumn(
        "adj_close", F.when(F.dayofmonth("trade_date") != 9, F.col("close"))).select("symbol", "trade_date", "adj_close")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = indicators.with_macd(prices).orderBy("symbol", "trade_date").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 240 and got.macd_golden_cross.notna().any()
    for _, rows in got.groupby("symbol"):
        series = pd.to_numeric(rows.adj_close)
        average = lambda v, span: v.ewm(span=span, adjust=False, ignore_na=False).mean().where(v.notna())
        dif = average(series, 12) - average(series, 26)
        assert rows.dif.astype(float).tolist() == pytest.approx(dif.tolist(), nan_ok=True)
        assert rows.dea.astype(float).tolist() == pytest.approx(average(dif, 9).tolist(), nan_ok=True)


def test_rank_002_is_tradable_only(factor_run):
    _, run = factor_run
    assert [r.symbol for r in research.rank_candidate_002(run, str(END), 5).collect()] == [A]


def test_backtest_002_with_two_benchmarks(factor_run, factor_inputs):
    _, run = factor_run
    result = research.backtest_candidate_002(run, factor_inputs.prices, 1, "weekly", ["000852.SH", "399006.SZ"])
    assert [r.benchmark_symbol for r in result.benchmarks.orderBy("position").collect()] == ["000852.SH", "399006.SZ"]
    dates = sorted(r.trade_date for r in trades.rebalance_dates(run, "weekly").collect())
    assert dates[:2] == [START, date(2025, 8, 4)]  # a Friday, then the Mondays
    assert result.trade_metrics.first().trade_count > 0
    with pytest.raises(ValueError):
        trades.rebalance_dates(run, "monthly")


def test_evaluation_tables_against_brute_force(factor_run, factor_inputs):
    ws, run = factor_run
    tables = research.evaluate_factors(run, factor_inputs.prices, 5, 5)
    returns = trades.forward_returns(factor_inputs.prices, 5).select("symbol", "trade_date", "forward_return")
    joined = run.join(returns, ["symbol", "trade_date"]).filter("forward_return is not null").toPandas()
    by_date = tables["ic_by_date"].toPandas()
    for name in ("mom_20", "flow_5d", "total_score"):
        for day, rows in joined.groupby("trade_date"):
            got = by_date[(by_date.factor == name) & (by_date.trade_date == day)]
            assert len(got) == 1
            expected = rows[name].astype(float).corr(rows.forward_return.astype(float))
            assert got.ic.iloc[0] == pytest.approx(expected, abs=1e-9)
    groups = tables["group_returns"].toPandas()
    assert set(groups["group"]) <= set(range(5)) and groups.sample_count.sum() == sum(
        joined[c].notna().sum() for c in evaluation.EVALUATED_FACTORS
    )
    cover = {r.factor: (r.non_null_count, r.row_count) for r in tables["coverage"].collect()}
    assert cover["mom_20"] == (60, 60)
    matrix = {r.factor: r.asDict() for r in tables["correlation"].collect()}
    assert matrix["mom_20"]["mom_60"] == pytest.approx(matrix["mom_60"]["mom_20"])
    assert matrix["mom_20"]["mom_20"] == pytest.approx(1.0)
    assert len(research.evaluate_factor_run(ws, "factor_002_test", factor_inputs.prices, 5, 5)) == 5


def test_evaluation_does_not_depend_on_the_parts(factor_run, factor_inputs, monkeypatch):
    _, run = factor_run
    pairs = evaluation.paired(run, factor_inputs.prices, 5, ["mom_20", "flow_persistence"])
    found = []
    for rows in (7, 250_000):
        monkeypatch.setattr(ranking, "PART_ROWS", rows)
        found.append((
            evaluation.ic_by_date(pairs).orderBy("factor", "trade_date").toPandas(),
            evaluation.group_returns(pairs, 5).orderBy("factor", "group").toPandas(),
        ))
    assert found[0][0].rank_ic.tolist() == pytest.approx(found[1][0].rank_ic.tolist(), nan_ok=True)
    assert found[0][1].sample_count.tolist() == found[1][1].sample_count.tolist()


def test_wide_pairs_give_the_figures_of_long_pairs(spark, monkeypatch):
    """Ties, nulls, a constant factor and a date with too few pairs; nothing is stored for wide rows."""
    rows = [
        (f"S{i:02d}", date(2026, 1, 1 + i % 3) if i < 60 else date(2026, 1, 9), ((i * 7) % 11 - 5) / 8,
         None if i % 6 == 0 else float(i % 4), 1.0, float((i * 37) % 101))
        for i in range(62)
    ]
    wide = spark.createDataFrame(rows, "symbol string, trade_date date, forward_return double, a double, b double, c double")
    long = ranking.unpivot(wide, ["a", "b", "c"], ["symbol", "trade_date", "forward_return"])
    folder = spark.conf.get("spark.checkpoint.dir")

    def found(pairs):
        ic = {(r.factor, r.trade_date): (r.ic, r.rank_ic, r.sample_count) for r in evaluation.ic_by_date(pairs).collect()}
        groups = {(r.factor, r.group): (r.avg_forward_return, r.sample_count) for r in evaluation.group_returns(pairs, 5).collect()}
        return ic, groups

    expected = found(long)
    before = sorted(os.listdir(folder))
    seen = [found(wide)]
    assert sorted(os.listdir(folder)) == before
    monkeypatch.setattr(ranking, "DAY_ROWS", 2)
    seen.append(found(wide))
    for figures in seen:
        for got, right in zip(figures, expected):
            assert got.keys() == right.keys()
            for key, values in right.items():
                assert [v is None for v in got[key]] == [v is None for v in values]
                assert [v for v in got[key] if v is not None] == pytest.approx([v for v in values if v is not None], abs=1e-12)


def test_rows_of_a_repeated_key_follow_their_values(spark):
    """A key that comes twice has one return; its two rows are placed by their values, as for long pairs."""
    day = date(2026, 1, 5)
    rows = [("A", day, 0.1, 5.0), ("A", day, 0.1, 1.0), ("B", day, 0.2, 3.0), ("C", day, -0.1, 2.0), ("C", day, -0.1, 9.0)]
    for given in (rows, rows[::-1]):
        wide = spark.createDataFrame(given, "symbol string, trade_date date, forward_return double, a double")
        got = evaluation.ic_by_date(wide).first()
        assert got.sample_count == 5
        assert got.rank_ic == pytest.approx(np.corrcoef([4, 1, 3, 2, 5], [4, 3, 5, 1, 2])[0, 1])


def test_evaluation_rejects_bad_settings(factor_run, factor_inputs):
    _, run = factor_run
    with pytest.raises(ValueError):
        evaluation.paired(run, factor_inputs.prices, 0)
    with pytest.raises(ValueError):
        research.evaluate_factors(run, factor_inputs.prices, 5, 1)


def test_constant_factor_has_no_correlation(spark):
    rows = spark.createDataFrame(
        [("f", LAST, s, 1.0, r) for s, r in (("A", 0.1), ("B", 0.2), ("C", 0.3))],
        "factor string, trade_date date, symbol string, value double, forward_return double",
    )
    row = evaluation.ic_by_date(rows).first()
    assert row.ic is None and row.rank_ic == pytest.approx(1.0) and row.sample_count == 3
    assert evaluation.ic_by_date(rows.limit(2)).count() == 0


def test_report_files(workspace, spark):
    report = research.research_candidate_001(backtest_inputs(spark), holding_days=5)
    assert report.passing.count() == 0 and report.ranking.count() == 0
    assert len(research.write_report(workspace, "report_1", report)) == 4


# --- pools ------------------------------------------------------------------------

def pool_run(spark):
    rows = [
        ("600519.SH", "Kweichow Moutai", "食品饮料", 0.9, 0.9, 0.9, 0.8, 0.89),
        ("300750.SZ", "CATL", "电力设备", 0.8, 0.78, 0.85, 0.75, 0.8),
        ("688001.SH", "Star Sample", "电子", 0.65, 0.62, 0.7, 0.7, 0.7),
        ("000002.SZ", "Vanke A", "房地产", 0.5, 0.5, 0.65, 0.3, 0.58),
    ]
    return spark.createDataFrame(
        rows,
        "symbol string, name string, industry string, momentum_score double, flow_score double, liquidity_score double, "
        "risk_score double, total_score double",
    ).withColumns({
        "trade_date": F.lit(LAST), "tradable_flag": F.lit(True), "exclusion_reason": F.lit("none"),
    })


def test_pool_changes_against_previous(spark):
    previous = spark.createDataFrame(
        [("600519.SH", 3), ("300750.SZ", 2), ("688001.SH", 1), ("600000.SH", 4)], "symbol string, rank int"
    )
    current, changes, summary = research.build_candidate_pool(pool_run(spark), previous=previous, top=4)
    assert {r.symbol: r.change_status for r in changes.collect()} == {
        "600519.SH": "upgraded", "300750.SZ": "retained", "688001.SH": "downgraded", "000002.SZ": "newly_added",
        "600000.SH": "removed",
    }
    counted = summary.first()
    assert (counted.newly_added, counted.removed, counted.total) == (1, 1, 4)
    assert [r.symbol for r in pools.removed_from(current, previous).collect()] == ["600000.SH"]
    rows = {r.symbol: r for r in current.collect()}
    assert rows["600519.SH"].theme == "消费医药" and rows["600519.SH"].reason_summary == "价格趋势、资金活跃度、流动性"
    assert rows["688001.SH"].reason_summary == "流动性" and rows["000002.SZ"].reason_summary == "综合研究证据"
    assert rows["000002.SZ"].risk_summary == "weak_risk_score" and rows["688001.SH"].theme == "科技成长"


def test_first_pool_is_all_new(spark):
    _, changes, summary = research.build_candidate_pool(pool_run(spark), top=4)
    assert summary.first().newly_added == 4
    with pytest.raises(ValueError):
        research.build_candidate_pool(pool_run(spark), top=0)


def test_stock_without_a_previous_rank_is_retained(spark):
    previous = spark.createDataFrame([("600519.SH", None), ("gone", None)], "symbol string, rank int")
    _, changes, _ = research.build_candidate_pool(pool_run(spark), previous=previous, top=1)
    assert {r.symbol: r.change_status for r in changes.collect()} == {"600519.SH": "retained", "gone": "removed"}


def test_latest_factor_date_prefers_tradable(spark):
    rows = spark.createDataFrame(
        [(date(2026, 4, 27), True), (LAST, False)], "trade_date date, tradable_flag boolean"
    )
    assert pools.latest_factor_date(rows).first().trade_date == date(2026, 4, 27)
    assert pools.latest_factor_date(rows.filter("not tradable_flag")).first().trade_date == LAST


def test_correlation_of_pairs_with_gaps_and_constants(spark):
    import numpy as np
    import pandas as pd

    generator = np.random.default_rng(11)
    frame = pd.DataFrame({
        "a": generator.normal(size=500) + 1e6, "b": generator.normal(size=500), "flat": 0.1,
        "sparse": np.where(np.arange(500) % 50 == 0, generator.normal(size=500), np.nan), "never": np.nan,
    })
    frame.loc[::7, "b"] = np.nan
    rows = spark.createDataFrame(
        [tuple(None if v != v else float(v) for v in row) for row in frame.itertuples(index=False)],
        ", ".join(f"{c} double" for c in frame.columns),
    ).repartition(6)
    got = {(r.factor, r.other): r.correlation for r in evaluation.correlation(rows, list(frame.columns)).collect()}
    assert len(got) == 25
    expected = frame.corr()
    for pair in (("a", "b"), ("b", "a"), ("a", "sparse"), ("b", "sparse"), ("a", "a")):
        assert got[pair] == pytest.approx(expected.loc[pair], abs=1e-9)
    assert all(v is None for k, v in got.items() if "flat" in k or "never" in k)


def test_workers_do_not_need_the_package():
    """The tasks unpickle in a process that cannot import the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from factorspark.functions import arrow_tasks

    for task in (arrow_tasks.macd_of_symbols, arrow_tasks.pair_moments(["a"])):
        code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert 'factorspark' not in sys.modules"
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(task), cwd="/", timeout=120)
        assert done.returncode == 0
