"""Research jobs over stored tables: factor runs, evaluation, rankings, backtests, bundles."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import evaluation, factors, market, pools, portfolio, publishing, signals, trades
from ..operators.publishing import analyse_securities
from ..operators.ranking import crowded_days
from ..sources import artifacts
from ..sources.curated_tables import read_snapshot
from . import symbol_files
from .promotion import Workspace
from .runtime import materialise, prepare

REQUIRED = ["security_master", "daily_prices", "capital_flow_or_chip"]


@dataclass(frozen=True)
class Inputs:
    """Curated tables one research job reads."""

    prices: DataFrame
    flow: DataFrame
    security: DataFrame
    calendar: DataFrame


def snapshot_inputs(ws: Workspace, snapshot_id: str) -> Inputs:
    """The tables as they were when the snapshot was made, whatever was promoted since."""
    prepare(ws.spark)
    tables = read_snapshot(ws.spark, ws.root, snapshot_id, REQUIRED)
    prices = tables["daily_prices"]
    calendar = tables.get("trading_calendar", prices.select("trade_date"))
    return Inputs(prices, tables["capital_flow_or_chip"], tables["security_master"], calendar)


# --- strategy 001 ---------------------------------------------------------------

def rank_candidate_001(data: Inputs, top: int = 10) -> DataFrame:
    """Ranking on the last date of the price table."""
    rows = signals.on_latest_price_date(signals.candidates(data.prices, data.flow, data.security), data.prices)
    return signals.ranking(rows, signals.date_successors(data.calendar), top).drop("macd_golden_cross")


@dataclass(frozen=True)
class Backtest:
    trades: DataFrame
    trade_metrics: DataFrame
    portfolio: DataFrame
    return_metrics: DataFrame
    turnover: DataFrame
    monthly: DataFrame
    benchmarks: DataFrame


def measure(made: DataFrame, prices: DataFrame, holding_days: int, benchmark_symbol=None) -> Backtest:
    """All statistics of a set of trades. The trades are written once and read by each."""
    kept = materialise(made, "trades")
    series = portfolio.portfolio_returns(kept)
    named = portfolio.benchmark_list(benchmark_symbol)
    matched = portfolio.matched_returns(
        series, named, portfolio.benchmark_returns(prices, named, holding_days)
    )
    return Backtest(
        kept, portfolio.trade_metrics(kept), series, portfolio.return_metrics(series, holding_days),
        portfolio.turnover(series), portfolio.monthly_returns(series),
        portfolio.benchmark_metrics(matched, holding_days),
    )


def metrics_row(result: Backtest, primary_only: bool = True) -> DataFrame:
    """Every metric of a backtest beside each other, one row per benchmark (or the primary one)."""
    benchmarks = result.benchmarks.filter("position = 1") if primary_only else result.benchmarks
    single = {"trade_": result.trade_metrics, "return_": result.return_metrics, "turnover_": result.turnover}
    # one-row tables come in as scalar subqueries
    whole = benchmarks.withColumns({
        name: frame.select(F.struct(*frame.columns).alias("row")).scalar() for name, frame in single.items()
    })
    columns = [F.col(f"{name}.{c}") for name, frame in single.items() for c in frame.columns]
    return whole.select(*columns, *benchmarks.columns)


def backtest_candidate_001(data: Inputs, holding_days: int = 20, top: int = 10, benchmark_symbol=None) -> Backtest:
    rows = signals.candidates(data.prices, data.flow, data.security)
    return measure(trades.signal_trades(rows, data.prices, holding_days, top), data.prices, holding_days, benchmark_symbol)


@dataclass(frozen=True)
class Report:
    passing: DataFrame
    ranking: DataFrame
    backtest: Backtest


def research_candidate_001(data: Inputs, holding_days: int = 20, top: int = 10) -> Report:
    """Signal rows of the last price date, their explained ranking, and the whole backtest."""
    rows = materialise(signals.candidates(data.prices, data.flow, data.security), "signals")
    latest = signals.on_latest_price_date(rows, data.prices)
    successors = signals.date_successors(data.calendar)
    return Report(
        signals.pass_table(latest, successors),
        signals.explained_ranking(latest, successors, top),
        measure(trades.signal_trades(rows, data.prices, holding_days, top), data.prices, holding_days),
    )


def write_report(ws: Workspace, report_id: str, report: Report) -> list[str]:
    """Report tables as files of the run."""
    tables = {
        "factor_results": (report.passing, "csv"), "ranking_results": (report.ranking, "csv"),
        "backtest_trades": (report.backtest.trades, "csv"),
        "backtest_metrics": (metrics_row(report.backtest), "json"),
    }
    return [artifacts.write_result(frame, ws.root, report_id, name, form) for name, (frame, form) in tables.items()]


# --- strategy 002 ---------------------------------------------------------------

def compute_daily_factors(
    ws: Workspace, data: Inputs, start: str, end: str, run_id: str | None = None, snapshot_id: str | None = None
) -> str:
    """Compute and store a factor run."""
    run_id = run_id or f"factor_exploration_{uuid.uuid4().hex[:12]}"
    frame = factors.daily_factors(data.prices, data.flow, data.security, start, end)
    artifacts.write_factor_run(frame, ws.root, run_id)
    artifacts.write_run_record(
        ws.spark, ws.root, run_id, snapshot_id=snapshot_id, factor_version=fv.FACTOR_VERSION, start_date=start, end_date=end
    )
    return run_id


def evaluate_factors(run: DataFrame, prices: DataFrame, forward_days: int = 20, groups: int = 5) -> dict[str, DataFrame]:
    """Evaluation tables of a stored factor run; one pass over the paired rows gives all figures per date."""
    if groups < 2:
        raise ValueError("groups must be >= 2")
    pairs = evaluation.paired(run, prices, forward_days, wide=True)
    figures = materialise(evaluation.figures_by_day(pairs, groups=groups, crowded=crowded_days(run)), "factor-figures")
    by_date = evaluation.ic_of(figures)
    return {
        "ic_by_date": by_date,
        "group_returns": evaluation.group_returns_of(figures),
        "coverage": evaluation.coverage(run),
        "correlation": evaluation.correlation_matrix(run),
        "summary": evaluation.ic_summary(by_date),
    }


def evaluate_factor_run(ws: Workspace, run_id: str, prices: DataFrame, forward_days: int = 20, groups: int = 5) -> list[str]:
    run = artifacts.read_factor_run(ws.spark, ws.root, run_id)
    tables = evaluate_factors(run, prices, forward_days, groups)
    forms = {"summary": "json"}
    return [artifacts.write_result(t, ws.root, run_id, n, forms.get(n, "csv")) for n, t in tables.items()]


def rank_candidate_002(run: DataFrame, trade_date: str | None = None, top: int = 20) -> DataFrame:
    day = F.lit(trade_date).cast("date") if trade_date else run.agg(F.max("trade_date").alias("d")).scalar()
    return pools.ranked_tradable(run.filter(F.col("trade_date") == day), top).select(
        "rank", "symbol", "name", "trade_date", "total_score", "momentum_score", "flow_score", "chip_score",
        "risk_score", "liquidity_score", "exclusion_reason",
    )


def backtest_candidate_002(run: DataFrame, prices: DataFrame, top: int = 10, rebalance: str = "weekly", benchmark_symbol=None) -> Backtest:
    made = trades.factor_trades(run, prices, rebalance, top)
    return measure(made, prices, trades.holding_days_of(rebalance), benchmark_symbol)


# --- publishing -----------------------------------------------------------------

def build_market_status(prices: DataFrame, industry_daily: DataFrame, classification: DataFrame, trade_date: str | None = None) -> DataFrame:
    """Market status of one date, or of every price date."""
    days = prices.select("trade_date")
    if trade_date:
        days = prices.sparkSession.range(1).select(F.lit(trade_date).cast("date").alias("trade_date"))
    return market.market_status(days, prices, industry_daily, classification)


def build_candidate_pool(run: DataFrame, trade_date: str | None = None, previous: DataFrame | None = None, top: int = 10):
    """(pool rows, changes, summary) of one date; without a previous pool all rows are new."""
    day = F.lit(trade_date).cast("date") if trade_date else run.agg(F.max("trade_date").alias("d")).scalar()
    current = pools.pool_rows(run.filter(F.col("trade_date") == day), top)
    before = previous if previous is not None else current.limit(0)
    changes = pools.compare_pools(current, before)
    return current, changes, pools.diff_summary(changes)


def build_daily_bundle(
    run: DataFrame, prices, industry_daily, classification, top: int = 10, trade_date: str | None = None,
    previous: DataFrame | None = None, previous_version_id: str | None = None, snapshot_id: str | None = None,
) -> DataFrame:
    """The checked bundle of one date, by default the newest factor date with a tradable row.

    `previous` are the stocks of the pool before (symbol, rank). A bundle with errors is refused."""
    day = F.lit(trade_date).cast("date") if trade_date else pools.latest_factor_date(run).scalar()
    factors_of_day = run.filter(F.col("trade_date") == day)
    status = market.market_status(factors_of_day.select("trade_date"), prices, industry_daily, classification)
    pool = materialise(pools.pool_rows(factors_of_day, top), "pool")
    before = previous if previous is not None else pool.limit(0)
    version = previous_version_id or ("previous" if previous is not None else None)
    dates = pool.agg(F.max("trade_date").alias("d")).scalar()
    changes = pools.compare_pools(pool, before).withColumns(
        {"trade_date": dates, "previous_version_id": F.lit(version).cast("string")}
    )
    payloads = publishing.candidate_payloads(pool, changes, snapshot_id)
    bundle = materialise(publishing.with_bundle_errors(publishing.with_bundle_hash(
        publishing.daily_bundles(publishing.market_payloads(status), payloads, snapshot_id))), "bundle")
    wrong = bundle.filter(F.size("errors") > 0).select(F.array_join("errors", "; ")).first()  # one date, one row
    if wrong:
        raise ValueError(f"daily bundle failed validation: {wrong[0]}")
    return bundle.drop("errors")


def write_bundles(bundles: DataFrame, root: str) -> str:
    """One JSON object per date under its date's folder."""
    path = f"{root.rstrip('/')}/daily_bundles"
    bundles.withColumn("day", F.date_format("trade_date", "yyyyMMdd")).drop("trade_date").write.mode("append").partitionBy(
        "day").json(path)
    return path


def analyze_stock(run: DataFrame, symbols: list[str], trade_date: str | None = None) -> DataFrame:
    requested = run.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    return analyse_securities(requested, run, trade_date)


def refresh_quotes(ws: Workspace, symbols: list[str], trade_date: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest stored quote of each watched symbol."""
    watched = list(dict.fromkeys(s for s in symbols if s))[:limit]
    watch_list = ws.spark.createDataFrame([(s,) for s in watched], "symbol string")
    return publishing.latest_quotes(watch_list, symbol_files.rows_of(ws, "daily_prices", watched), trade_date)

