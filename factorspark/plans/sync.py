"""What has to be fetched: missing dates per dataset in the open window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import coverage

# Datasets kept in step
SYNC_DATASETS = [
    "daily_prices", "moneyflow_dc", "cyq_perf", "adj_factor", "daily_basic", "stk_limit", "suspend_d",
    "index_daily", "index_classify", "sw_daily",
]


def covered_dates(tables: dict[str, DataFrame | None], benchmarks: list[str]) -> DataFrame | None:
    """(dataset, trade_date) held by the current tables; absent tables cover nothing."""
    prices, flow, industry = (tables.get(n) for n in ("daily_prices", "capital_flow_or_chip", "industry_daily"))
    parts = []
    if prices is not None:
        parts += [coverage.price_coverage(prices), coverage.benchmark_coverage(prices, benchmarks)]
    if flow is not None:
        parts.append(coverage.flow_coverage(flow))
    if industry is not None:
        parts.append(coverage.generic_coverage(industry, "sw_daily"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def fetch_start(calendar: DataFrame, end: str, lookback_days: int = 45) -> DataFrame:
    """First date the provider calendar has to be asked for; the look-back alone without local dates."""
    fallback = F.date_sub(F.lit(end).cast("date"), lookback_days)
    return coverage.calendar_fetch_start(calendar, end, lookback_days).select(
        F.coalesce("fetch_start", fallback).alias("fetch_start")
    )


def plan_sync(
    raw_calendar: DataFrame, tables: dict[str, DataFrame | None], datasets: list[str] | None = None,
    start: str | None = None, benchmarks: list[str] | None = None, end: str | None = None, lookback_days: int = 45,
) -> DataFrame:
    """(dataset, trade_date) still to be fetched up to the last open date of the provider calendar.

    With an end date the provider calendar counts from `fetch_start` to that date."""
    if lookback_days <= 0:
        raise ValueError("lookback_days must be positive")
    wanted = datasets or SYNC_DATASETS
    unknown = sorted(set(wanted) - set(SYNC_DATASETS))
    if unknown:
        raise ValueError("unsupported sync datasets: " + ", ".join(unknown))
    opened = coverage.provider_open_dates(raw_calendar)
    local = tables.get("trading_calendar")
    if end is not None:
        since = F.date_sub(F.lit(end).cast("date"), lookback_days) if local is None else fetch_start(local, end, lookback_days).scalar()
        opened = opened.filter((F.col("trade_date") <= F.lit(end).cast("date")) & (F.col("trade_date") >= since))
    days = opened if local is None else coverage.calendar_union(coverage.local_open_dates(local), opened)
    latest = opened.agg(F.max("trade_date").alias("d")).scalar()
    days = days.filter(F.col("trade_date") <= latest)
    covered = covered_dates(tables, benchmarks or fv.BENCHMARK_SYMBOLS)
    if covered is None:
        covered = days.limit(0).select(F.lit("").alias("dataset"), "trade_date")
    if start is None:
        first = coverage.sync_start(days, covered.filter(F.col("dataset").isin(wanted))).scalar()
    else:
        first = F.lit(start).cast("date")
    window = days.filter(F.col("trade_date") >= first)
    dated = [d for d in wanted if d != "index_classify"]
    missing = coverage.missing_dates(window, dated, covered)
    if "index_classify" in wanted:
        # classification has no dates: the last open date stands for it while the table is empty
        classification = tables.get("industry_classification")
        last = window.agg(F.max("trade_date").alias("trade_date"))
        if classification is not None:
            rows = classification.agg(F.count(F.lit(1)).alias("n")).scalar()
            last = last.filter(rows == 0)
        missing = missing.unionByName(last.select(F.lit("index_classify").alias("dataset"), "trade_date"))
    return missing
