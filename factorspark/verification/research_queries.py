"""Indicators, factors, signals, trades, portfolio and evaluation (H to N)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import rolling
from ..operators import evaluation, factors, indicators, portfolio, signals, trades
from ..operators.ranking import crowded_days
from ..operators.selection import exact_median
from ..plans import research
from ..plans.promotion import Workspace
from ..plans.runtime import materialise, new_path
from ..sources import artifacts
from ..sources.weekly_bars import MarketTables
from . import sql
from .registry import near, registered, signed_log
from .sql import log_all, near_all

R = "symbol, trade_date"


@lru_cache
def adjusted(m: MarketTables) -> DataFrame:
    return indicators.adjust_prices(m.prices)


def stock_history(m: MarketTables) -> DataFrame:
    return indicators.stocks_only(adjusted(m))


# --- H ------------------------------------------------------------------------

@registered("h01_adjusted_prices", f"SELECT {R}, {near_all(['adj_close', 'adj_open'], 4)} FROM adjusted")
def _(m):
    return near(adjusted(m).select("symbol", "trade_date", "adj_close", "adj_open"), ["adj_close", "adj_open"], 4)


def _indicator(key: str, name: str, digits: int = 6):
    @registered(key, f"SELECT {R}, {near_all([name], digits)} FROM priceind")
    def _(m):
        return near(indicators.price_indicators(stock_history(m)).select("symbol", "trade_date", name), [name], digits)


_indicator("h02_daily_return", "daily_return")
_indicator("h06_ma_strength", "ma_strength")
_indicator("h07_avg_amount", "avg_amount_20", 3)
_indicator("h08_turnover_stability", "turnover_stability")
_indicator("h11_distance_from_high", "max_drawdown_60")


@registered("h03_momentum", f"SELECT {R}, {near_all(['mom_20', 'mom_60'])} FROM priceind")
def _(m):
    rows = stock_history(m).select(
        "symbol", "trade_date",
        indicators.change_over("adj_close", 20).alias("mom_20"), indicators.change_over("adj_close", 60).alias("mom_60"),
    )
    return near(rows, ["mom_20", "mom_60"])


def _macd(m):
    return indicators.with_macd(stock_history(m).select("symbol", "trade_date", "adj_close"))


@registered("h04_ema", f"SELECT {R}, {near_all(['ema12', 'ema26'], 4)} FROM macd")
def _(m):
    return near(_macd(m).select("symbol", "trade_date", "ema12", "ema26"), ["ema12", "ema26"], 4)


@registered("h05_macd_cross", f"SELECT {R}, {near_all(['dif', 'dea'], 4)}, macd_golden_cross FROM macd")
def _(m):
    return near(_macd(m).select("symbol", "trade_date", "dif", "dea", "macd_golden_cross"), ["dif", "dea"], 4)


@registered("h09_volatility", f"SELECT {R}, {near_all(['vol_20'])} FROM priceind")
def _(m):
    return near(indicators.price_indicators(stock_history(m)).select("symbol", "trade_date", "vol_20"), ["vol_20"])


_FALLING_SQL = """10000.0::DOUBLE / (row_number() OVER (PARTITION BY symbol ORDER BY trade_date) + 0.5::DOUBLE * (close - floor(close)))
  + CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY trade_date) % 50 = 0 THEN 9000.0::DOUBLE ELSE 0.0::DOUBLE END"""


@registered("h10_downside_volatility", f"SELECT {R}, {near_all(['downside_vol_20'])} FROM priceind")
def _(m):
    rows = indicators.price_indicators(stock_history(m)).select("symbol", "trade_date", "downside_vol_20")
    return near(rows, ["downside_vol_20"])


@registered("h10_downside_of_falling", f"""
SELECT symbol, trade_date, CASE WHEN count(moved) OVER w >= 20 THEN floor((stddev_samp(moved) OVER w) * 1e8 + 0.5001) / 1e8 END AS downside_vol_20
FROM (SELECT symbol, trade_date, CASE WHEN moved < 0 THEN moved END AS moved FROM (SELECT symbol, trade_date, adj / lag(adj) OVER s - 1 AS moved
  FROM (SELECT symbol, trade_date, {_FALLING_SQL} AS adj FROM prices WHERE asset_type <> 'index') WINDOW s AS (PARTITION BY symbol ORDER BY trade_date)))
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(m):
    """Prices that fall with every row but for some days: whole windows of losses occur."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date"))
    falling = F.lit(10000.0) / (place + F.lit(0.5) * (F.col("close") - F.floor("close"))) + F.when(place % 50 == 0, 9000.0).otherwise(0.0)
    rows = stock_history(m).withColumn("adj_close", falling)
    return near(indicators.price_indicators(rows).select("symbol", "trade_date", "downside_vol_20"), ["downside_vol_20"], 8)


def _flow_query(key, names):
    @registered(key, f"SELECT {R}, {near_all(names)} FROM flowind")
    def _(m):
        return near(indicators.flow_indicators(m.flow).select("symbol", "trade_date", *names), names)


_flow_query("h12_flow_sums", ["flow_5d", "flow_20d"])
_flow_query("h13_flow_persistence", ["flow_persistence"])
_flow_query("h14_winner_rate", ["winner_rate", "winner_rate_change_5d", "winner_rate_change_20d"])


@registered("h15_period_return", f"""
SELECT symbol, trade_date, {sql.near("CASE WHEN n >= 2 THEN (last_close / first_close - 1) * 100 END")} AS period_return
FROM (SELECT symbol, trade_date, count(*) OVER w AS n, last_value(close) OVER w AS last_close, first_value(close) OVER w AS first_close
  FROM prices WHERE asset_type = 'index'
  WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def _(m):
    rows = m.prices.filter(F.col("asset_type") == "index")
    return near(indicators.period_return(rows, 5), ["period_return"])


@registered("h16_stock_universe", "SELECT symbol, count(*) AS bar_count FROM prices WHERE coalesce(asset_type, 'stock') <> 'index' GROUP BY symbol")
def _(m):
    return indicators.stocks_only(m.prices).groupBy("symbol").agg(F.count(F.lit(1)).alias("bar_count"))


# --- I ------------------------------------------------------------------------

@lru_cache
def crowded(m: MarketTables) -> list:
    """Days of very many stock prices, hence of very many factor rows and pairs.

    A bar has a shipment at least, so bars are counted only in weeks of very many shipments."""
    busy = crowded_days(m.shipments)
    return crowded_days(indicators.stocks_only(m.prices).filter(F.col("trade_date").isin(busy))) if busy else []


@lru_cache
def factor_run(m: MarketTables) -> DataFrame:
    return factors.daily_factors(m.prices, m.flow, m.security, crowded=crowded(m))


@lru_cache
def assembled(m: MarketTables) -> DataFrame:
    return factors.assemble(m.prices, m.flow, m.security)


ASSEMBLED = ["mom_20", "mom_60", "ma_strength", "flow_5d", "flow_20d", "flow_persistence", "winner_rate", "vol_20",
             "max_drawdown_60", "turnover_stability"]


@registered("i1_factor_assembly", f"""
SELECT {R}, name, market_segment, industry, status, macd_signal, {near_all(ASSEMBLED)} FROM assembled
WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""")
def _(m):
    rows = factors.assemble(m.prices, m.flow, m.security, "1998-01-01", "2000-12-31").select(
        "symbol", "trade_date", "name", "market_segment", "industry", "status", "macd_signal", *ASSEMBLED
    )
    return near(rows, ASSEMBLED)


@registered("i2_rank_scores", f"SELECT {R}, {', '.join(sql.near('s_' + c, 8) + ' AS score_' + c for c, _ in sql.SCORED)} FROM ranks")
def _(m):
    ranked = factors.wide_average_ranks(assembled(m), factors.RANKED_INPUTS, crowded=crowded(m))
    names = [f"score_{c}" for c, _ in sql.SCORED]
    return near(
        ranked.select("symbol", "trade_date", *[
            factors.rank_score(c, inverse).alias(f"score_{c}") for c, inverse in sql.SCORED
        ]), names, 8)


@registered("i3_chip_score", f"SELECT {R}, {near_all(['chip_score'], 8)} FROM scored")
def _(m):
    rows = indicators.flow_indicators(m.flow).select("symbol", "trade_date", factors.chip_score().alias("chip_score"))
    return near(rows, ["chip_score"], 8)


SCORES = ["momentum_score", "flow_score", "chip_score", "risk_score", "liquidity_score"]


@registered("i4_composite_scores", f"SELECT {R}, {near_all(SCORES, 8)} FROM scored")
def _(m):
    return near(factor_run(m).select("symbol", "trade_date", *SCORES), SCORES, 8)


@registered("i5_total_score", f"SELECT {R}, {near_all(['total_score'], 8)} FROM scored")
def _(m):
    return near(factor_run(m).select("symbol", "trade_date", "total_score"), ["total_score"], 8)


@registered("i6_exclusion_reason", f"SELECT {R}, exclusion_reason FROM factors")
def _(m):
    return assembled(m).select("symbol", "trade_date", factors.exclusion_reason().alias("exclusion_reason"))


@registered("i7_tradable_flag", f"SELECT {R}, tradable_flag, factor_version FROM factors")
def _(m):
    return factor_run(m).select("symbol", "trade_date", "tradable_flag", "factor_version")


MEASURES = [c for c in fv.FACTOR_COLUMNS if c not in (
    "symbol", "trade_date", "name", "market_segment", "industry", "macd_signal", "tradable_flag",
    "exclusion_reason", "factor_version", "avg_amount_20")]


@registered("i8_daily_factors", f"""
SELECT {R}, name, market_segment, industry, macd_signal, {near_all(MEASURES)}, {near_all(['avg_amount_20'], 3)},
  tradable_flag, exclusion_reason, factor_version FROM factors""")
def _(m):
    return near(near(factor_run(m), MEASURES), ["avg_amount_20"], 3)


# --- J ------------------------------------------------------------------------

SIGNAL = ["close", "main_net_inflow_rate", "close_profit_ratio", "return_20d"]


@lru_cache
def signal_rows(m: MarketTables) -> DataFrame:
    return signals.candidates(m.prices, m.flow, m.security)


@registered("j1_signal_candidates", f"SELECT {R}, name, {near_all(SIGNAL, 5)} FROM signals")
def _(m):
    return near(signal_rows(m).select("symbol", "trade_date", "name", *SIGNAL), SIGNAL, 5)


_RANK_COLUMNS = f"place AS rank, symbol, name, trade_date AS signal_date, recommend_trade_date, {near_all(SIGNAL, 5)}"


@registered("j2_latest_ranking", f"""
SELECT {_RANK_COLUMNS} FROM rankedsignals JOIN successors USING (trade_date)
WHERE place <= 10 AND trade_date = (SELECT max(trade_date) FROM prices)""")
def _(m):
    latest = signals.on_latest_price_date(signal_rows(m), m.prices)
    rows = signals.ranking(latest, signals.date_successors(m.calendar), 10)
    return near(rows.drop("reason", "macd_golden_cross"), SIGNAL, 5)


def last_signal_ranking(m: MarketTables, top: int = 10) -> DataFrame:
    """Ranking of the last date that has a candidate."""
    rows = signal_rows(m)
    latest = rows.agg(F.max("trade_date").alias("latest")).scalar()
    return signals.ranking(rows.filter(F.col("trade_date") == latest), signals.date_successors(m.calendar), top)


@registered("j2_last_signal_ranking", f"""
SELECT {_RANK_COLUMNS} FROM rankedsignals JOIN successors USING (trade_date)
WHERE place <= 10 AND trade_date = (SELECT max(trade_date) FROM signals)""")
def _(m):
    return near(last_signal_ranking(m).drop("reason", "macd_golden_cross"), SIGNAL, 5)


def _factor_value_numbers(frame):
    """The figures inside the factor_value text, read back from it."""
    def figure(name):
        return F.regexp_extract("factor_value", f"{name}=(-?[0-9.E-]+)", 1).try_cast("double").alias(f"shown_{name}")

    return [figure(n) for n in ("main_net_inflow_rate", "close_profit_ratio", "return_20d")]


@registered("j3_explained_ranking", f"""
SELECT place AS rank, symbol, trade_date AS signal_date, recommend_trade_date, {sql.near('main_net_inflow_rate', 4)} AS shown_main_net_inflow_rate,
  {sql.near('close_profit_ratio', 4)} AS shown_close_profit_ratio, {sql.near('return_20d', 6)} AS shown_return_20d, TRUE AS names_cross
FROM rankedsignals JOIN successors USING (trade_date) WHERE place <= 10""")
def _(m):
    rows = signals.explained_ranking(signal_rows(m), signals.date_successors(m.calendar), 10)
    return rows.select(
        "rank", "symbol", "signal_date", "recommend_trade_date", *_factor_value_numbers(rows),
        F.contains("factor_value", F.lit("macd_golden_cross=true")).alias("names_cross"),
    )


@registered("j4_pass_table", f"""
SELECT place AS factor_rank, symbol, name, trade_date AS signal_date, recommend_trade_date, TRUE AS pass_main_net_inflow_rate, macd_golden_cross,
  TRUE AS pass_macd_golden_cross, TRUE AS pass_close_profit_ratio, TRUE AS pass_exclude_st, TRUE AS factor_pass, {near_all(SIGNAL, 5)}
FROM rankedsignals JOIN successors USING (trade_date)""")
def _(m):
    rows = signals.pass_table(signal_rows(m), signals.date_successors(m.calendar))
    return near(rows.drop("factor_value", "reason"), SIGNAL, 5)


@registered("j5_top_per_date", f"SELECT {R}, place FROM rankedsignals WHERE place <= 3")
def _(m):
    return signals.top_per_group(signal_rows(m), ["trade_date"], signals.candidate_order(), 3, "place").select(
        "symbol", "trade_date", "place"
    )


@registered("j6_research_report", f"""
SELECT 'factor_results' AS part, trade_date AS day, symbol, place::DOUBLE AS figure FROM rankedsignals
UNION ALL SELECT 'ranking_results', trade_date, symbol, place::DOUBLE FROM rankedsignals WHERE place <= 10
UNION ALL SELECT 'backtest_trades', trade_date, symbol, {sql.near('forward_return')} FROM trades
UNION ALL SELECT 'backtest_metrics', NULL, 'trade_count', count(*)::DOUBLE FROM trades
UNION ALL SELECT 'backtest_metrics', NULL, 'signal_dates', count(DISTINCT trade_date)::DOUBLE FROM trades""")
def _(m):
    """The report of all dates written as files and read back."""
    rows = materialise(signal_rows(m), "signals")
    successors = signals.date_successors(m.calendar)
    report = research.Report(
        signals.pass_table(rows, successors), signals.explained_ranking(rows, successors, 10),
        research.measure(signal_trades(m), m.prices, 20),
    )
    ws = Workspace(m.spark, new_path(m.spark, "reports"))
    research.write_report(ws, "report", report)
    back = lambda name, schema, form="csv": artifacts.read_result(m.spark, ws.root, "report", name, schema, form)
    passing = back("factor_results", report.passing.schema).select(
        F.lit("factor_results").alias("part"), F.col("signal_date").alias("day"), "symbol", F.col("factor_rank").cast("double").alias("figure"))
    ranking = back("ranking_results", report.ranking.schema).select(
        F.lit("ranking_results"), "signal_date", "symbol", F.col("rank").cast("double"))
    made = near(back("backtest_trades", report.backtest.trades.schema), ["forward_return"]).select(
        F.lit("backtest_trades"), "trade_date", "symbol", "forward_return")
    measured = back("backtest_metrics", "trade_count bigint, signal_dates bigint", "json").select(F.inline(F.array(*[
        F.struct(F.lit("backtest_metrics"), F.lit(None).cast("date"), F.lit(c), F.col(c).cast("double")) for c in ("trade_count", "signal_dates")])))
    return passing.union(ranking).union(made).union(measured)


# --- K ------------------------------------------------------------------------

PRICES = ["raw_entry_price", "entry_price", "raw_exit_price", "exit_price"]


@registered("k1_entry_exit", f"SELECT {R}, recommend_trade_date, exit_trade_date, {near_all(PRICES, 4)} FROM exits20")
def _(m):
    return near(trades.entry_exit(m.prices, 20), PRICES, 4)


@registered("k2_forward_return", f"SELECT {R}, {near_all(['forward_return'])} FROM exits5")
def _(m):
    return near(trades.forward_returns(m.prices, 5).select("symbol", "trade_date", "forward_return"), ["forward_return"])


def signal_trades(m: MarketTables) -> DataFrame:
    return trades.signal_trades(signal_rows(m), m.prices, 20, 10)


@registered("k3_signal_trades", f"SELECT {R}, place, recommend_trade_date, exit_trade_date, {near_all(['forward_return'])} FROM trades")
def _(m):
    rows = signal_trades(m).select("symbol", "trade_date", "place", "recommend_trade_date", "exit_trade_date", "forward_return")
    return near(rows, ["forward_return"])


@registered("k4_rebalance_dates", """
SELECT min(d) AS trade_date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY strftime(d, '%G-%V')""")
def _(m):
    return trades.rebalance_dates(m.raw("orders").select(F.col("o_orderdate").cast("date").alias("trade_date")), "weekly")


def stored_factors(m: MarketTables, columns: list[str]) -> DataFrame:
    """The columns of the factor run that a plan reads, all rows, written once for plans that read them more than once."""
    return materialise(factor_run(m).select("symbol", "trade_date", "tradable_flag", *columns), "factor-run")


def factor_trades(m: MarketTables, rebalance: str) -> DataFrame:
    return trades.factor_trades(stored_factors(m, ["total_score"]), indicators.stocks_only(m.prices), rebalance, 10)


for _rebalance in ("weekly", "daily"):
    @registered(f"k5_factor_trades_{_rebalance}", f"""
SELECT {R}, place, exit_trade_date, {near_all(['total_score', 'forward_return'])} FROM {_rebalance}trades""")
    def _(m, rebalance=_rebalance):
        rows = factor_trades(m, rebalance).select(
            "symbol", "trade_date", "place", "exit_trade_date", "total_score", "forward_return"
        )
        return near(rows, ["total_score", "forward_return"])


# --- L ------------------------------------------------------------------------

TRADE_MEASURES = ["avg_forward_return", "median_forward_return", "win_rate", "best_trade_return", "worst_trade_return", "return_std"]
_TRADE_METRICS = """count(*) AS trade_count, count(DISTINCT trade_date) AS signal_dates, avg(forward_return) AS avg_forward_return,
  median(forward_return) AS median_forward_return, avg(CAST(forward_return > 0 AS DOUBLE)) AS win_rate, max(forward_return) AS best_trade_return,
  min(forward_return) AS worst_trade_return, stddev_samp(forward_return) AS return_std"""


def signal_portfolio(m: MarketTables) -> DataFrame:
    return portfolio.portfolio_returns(signal_trades(m))


@registered("l1_trade_metrics", f"SELECT trade_count, signal_dates, {near_all(TRADE_MEASURES)} FROM (SELECT {_TRADE_METRICS} FROM trades)")
def _(m):
    return near(portfolio.trade_metrics(signal_trades(m)), TRADE_MEASURES)


@registered("l1_selected_medians", """
SELECT 'all' AS setting, CAST(NULL AS VARCHAR) AS symbol, median(close) AS median_close FROM prices WHERE close IS NOT NULL
UNION ALL SELECT 'symbol', symbol, median(close) FROM prices WHERE close IS NOT NULL GROUP BY symbol
UNION ALL SELECT 'rounded', CAST(NULL AS VARCHAR), median(floor(close / 1000)) FROM prices WHERE close IS NOT NULL""")
def _(m):
    """Medians by selection: of all rows over many tasks, of many groups, and of values that most rows share."""
    rows = m.prices.select("symbol", "close")
    everything = exact_median(rows, "close", most_rows=100).select(
        F.lit("all").alias("setting"), F.lit(None).cast("string").alias("symbol"), F.col("median").alias("median_close"))
    each = exact_median(rows, "close", ["symbol"], parts=4, most_rows=20).select(F.lit("symbol").alias("setting"), "symbol", F.col("median").alias("median_close"))
    shared = exact_median(rows.withColumn("close", F.floor(F.col("close") / 1000).cast("double")), "close", most_rows=100)
    return everything.unionByName(each).unionByName(
        shared.select(F.lit("rounded").alias("setting"), F.lit(None).cast("string").alias("symbol"), F.col("median").alias("median_close")))


@registered("l2_portfolio_returns", f"""
SELECT trade_date, {near_all(['portfolio_return'])}, array_to_string(symbols, ',') AS symbols FROM portfolio""")
def _(m):
    rows = signal_portfolio(m).withColumn("symbols", F.array_join("symbols", ","))
    return near(rows, ["portfolio_return"])


RETURN_MEASURES = ["total_return", "max_drawdown", "annual_return", "annual_volatility", "sharpe_ratio", "calmar_ratio"]
_L_KEYS = {
    "l3_compound_return": ["total_return"],
    "l4_annual_return": ["annual_return"],
    "l5_volatility_sharpe": ["annual_volatility", "sharpe_ratio"],
    "l6_drawdown_calmar": ["max_drawdown", "calmar_ratio"],
}
# compounded figures, compared on a log scale
COMPOUNDED = {"total_return", "annual_return", "sharpe_ratio", "calmar_ratio", "benchmark_return", "excess_return"}


def compare_all(names) -> str:
    plain, logs = [n for n in names if n not in COMPOUNDED], [n for n in names if n in COMPOUNDED]
    return ", ".join(part for part in [near_all(plain), log_all(logs)] if part)


def comparable(frame, names):
    return near(signed_log(frame, [n for n in names if n in COMPOUNDED]), names)


for _key, _names in _L_KEYS.items():
    @registered(_key, f"SELECT period_count, {compare_all(_names)} FROM ({sql.return_statistics('portfolio', '(252.0::DOUBLE / 20)')})")
    def _(m, names=_names):
        return comparable(portfolio.return_metrics(signal_portfolio(m), 20).select("period_count", *names), names)


def _turnover(key, name, sql_value):
    @registered(key, f"""
SELECT {sql.near('avg(' + sql_value + ')')} AS {name}
FROM (SELECT symbols, lag(symbols) OVER (ORDER BY trade_date) AS before FROM portfolio) WHERE before IS NOT NULL""")
    def _(m):
        return near(portfolio.turnover(signal_portfolio(m)).select(name), [name])


_turnover("l7_turnover", "turnover_proxy", "1 - len(list_intersect(symbols, before)) / len(symbols)")
_turnover("l8_holding_overlap", "holding_overlap",
          "len(list_intersect(symbols, before)) / len(list_distinct(list_concat(symbols, before)))")


@registered("l9_monthly_returns", f"""
SELECT strftime(trade_date, '%Y-%m') AS month, {sql.near('product(1 + portfolio_return) - 1')} AS monthly_return FROM portfolio GROUP BY 1""")
def _(m):
    return near(portfolio.monthly_returns(signal_portfolio(m)), ["monthly_return"])


def _matched(m, frame, days, symbols):
    named = portfolio.benchmark_list(symbols)
    return portfolio.matched_returns(frame, named, portfolio.benchmark_returns(m.prices, named, days))


@registered("l10_benchmark_forward_returns", f"""
SELECT p.trade_date, k.benchmark_symbol, {sql.near('p.portfolio_return')} AS portfolio_return, {sql.near('e.forward_return')} AS benchmark_return
FROM portfolio p JOIN (VALUES ('000852.SH'), ('000300.SH')) k(benchmark_symbol) ON TRUE
LEFT JOIN exits20 e ON e.symbol = k.benchmark_symbol AND e.trade_date = p.trade_date""")
def _(m):
    rows = _matched(m, signal_portfolio(m), 20, ["000852.SH", "000300.SH"]).drop("position")
    return near(rows, ["portfolio_return", "benchmark_return"])


BENCHMARK_MEASURES = ["benchmark_return", "excess_return", "tracking_error", "information_ratio"]


def _benchmark_query(key, frame, table, exits_part, days, symbols):
    select = sql.benchmark_statistics(table, exits_part, f"(252.0::DOUBLE / {days})", portfolio.benchmark_list(symbols))

    @registered(key, f"SELECT benchmark_symbol, position, missing_dates, {compare_all(BENCHMARK_MEASURES)} FROM ({select})")
    def _(m):
        rows = portfolio.benchmark_metrics(_matched(m, frame(m), days, symbols), days)
        return comparable(rows, BENCHMARK_MEASURES)


_benchmark_query("l11_benchmark_relative", signal_portfolio, "portfolio", "exits20", 20, None)
_benchmark_query("l12_multi_benchmark", signal_portfolio, "portfolio", "exits20", 20,
                 ["399006.SZ", "000852.SH", "399006.SZ", "899050.BJ", "000688.SH"])


_BACKTEST_MEASURES = TRADE_MEASURES + RETURN_MEASURES + ["turnover_proxy", "holding_overlap"] + BENCHMARK_MEASURES


def _backtest_query(key, made, trades_part, portfolio_part, exits_part, days):
    per_year = f"(252.0::DOUBLE / {days})"
    select = f"""
SELECT trade_count, signal_dates, period_count, benchmark_symbol, position, missing_dates, {compare_all(_BACKTEST_MEASURES)}
FROM (SELECT {_TRADE_METRICS} FROM {trades_part}) JOIN ({sql.return_statistics(portfolio_part, per_year)}) ON TRUE
JOIN (SELECT avg(1 - len(list_intersect(symbols, before)) / len(symbols)) AS turnover_proxy,
  avg(len(list_intersect(symbols, before)) / len(list_distinct(list_concat(symbols, before)))) AS holding_overlap
  FROM (SELECT symbols, lag(symbols) OVER (ORDER BY trade_date) AS before FROM {portfolio_part}) WHERE before IS NOT NULL) ON TRUE
JOIN ({sql.benchmark_statistics(portfolio_part, exits_part, per_year, [fv.DEFAULT_BENCHMARK])}) ON TRUE"""

    @registered(key, select)
    def _(m):
        result = research.measure(made(m), m.prices, days)
        return comparable(research.metrics_row(result), _BACKTEST_MEASURES)


_backtest_query("l13_signal_backtest", signal_trades, "trades", "portfolio", "exits20", 20)
_backtest_query("l13_factor_backtest_weekly", lambda m: factor_trades(m, "weekly"), "weeklytrades", "weeklyportfolio", "exits5", 5)
_backtest_query("l13_factor_backtest_daily", lambda m: factor_trades(m, "daily"), "dailytrades", "dailyportfolio", "exits1", 1)

_SWEEP_DAYS, _SWEEP_TOPS = [3, 5, 10, 20], [3, 10]
_SWEEP_TRADES = " UNION ALL ".join(
    f"SELECT {d} AS holding_days, {t} AS top, trade_date, symbol, forward_return FROM rankedsignals JOIN exits{d} USING (symbol, trade_date) "
    f"WHERE place <= {t} AND forward_return IS NOT NULL" for d in _SWEEP_DAYS for t in _SWEEP_TOPS
)
_SWEEP_PORTFOLIO = f"(SELECT holding_days, top, trade_date, avg(forward_return) AS portfolio_return FROM ({_SWEEP_TRADES}) GROUP BY ALL)"


@registered("l14_parameter_sweep", f"""
SELECT holding_days, top, period_count, {compare_all(RETURN_MEASURES)}
FROM ({sql.return_statistics(_SWEEP_PORTFOLIO, '(252.0::DOUBLE / holding_days)', 'holding_days, top, ')})""")
def _(m):
    return comparable(portfolio.sweep(signal_rows(m), m.prices, _SWEEP_DAYS, _SWEEP_TOPS), RETURN_MEASURES)


# --- M ------------------------------------------------------------------------

def pairs(m: MarketTables, days: int = 20, wide: bool = False) -> DataFrame:
    """Factors are of stocks only, so are the prices paired with them."""
    return evaluation.paired(factor_run(m), indicators.stocks_only(m.prices), days, wide=wide)



@registered("m1_ic_by_date", f"SELECT factor, trade_date, sample_count, {near_all(['ic'])} FROM icbydate")
def _(m):
    return near(evaluation.ic_only(pairs(m)), ["ic"])


@registered("m2_rank_ic", f"SELECT factor, trade_date, sample_count, {near_all(['rank_ic'])} FROM icbydate")
def _(m):
    return near(evaluation.ic_by_date(pairs(m, wide=True), crowded=crowded(m)).drop("ic"), ["rank_ic"])


@registered("m3_group_returns", f"""
SELECT factor, "group", {sql.near('avg(forward_return)')} AS avg_forward_return, count(*) AS sample_count
FROM (SELECT *, CAST(least(greatest(floor(({sql.average_rank_sql('value', 'factor, trade_date')} - 1) / count(*) OVER (PARTITION BY factor, trade_date) * 5), 0), 4) AS BIGINT) AS "group"
  FROM evaluated) GROUP BY 1, 2""")
def _(m):
    return near(evaluation.group_returns(pairs(m, wide=True), 5, crowded=crowded(m)), ["avg_forward_return"])


@registered("m4_coverage", f"""
SELECT factor, count(*) AS non_null_count, (SELECT count(*) FROM factors) AS row_count,
  {sql.near('count(*)::DOUBLE / (SELECT count(*) FROM factors)')} AS coverage FROM longfactors GROUP BY 1""")
def _(m):
    return near(evaluation.coverage(factor_run(m)), ["coverage"])


@registered("m5_correlation", " UNION ALL ".join(
    f"SELECT {sql.text(a)} AS factor, {sql.text(b)} AS other, "
    f"{sql.near(sql.pearson_sql('a', 'b'))} AS correlation FROM (SELECT {a} AS a, {b} AS b FROM factors WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    for a in fv.EVALUATED_FACTORS for b in fv.EVALUATED_FACTORS))
def _(m):
    return near(evaluation.correlation(factor_run(m)), ["correlation"])


_SUMMARY = ["mean_ic", "icir", "mean_rank_ic", "rank_icir"]


@registered("m6_ic_summary", f"""
SELECT factor, date_count, {near_all(_SUMMARY)} FROM (SELECT factor, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir,
  avg(rank_ic) AS mean_rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_icir, count(*) AS date_count FROM icbydate GROUP BY 1)""")
def _(m):
    return near(evaluation.ic_summary(evaluation.ic_by_date(pairs(m, wide=True), crowded=crowded(m))), _SUMMARY)


# m7, the evaluation of a stored run, is registered with the publishing queries.
