"""Trading calendar, date coverage and provider work lists.

Everything after the first aggregate is one row per calendar date and dataset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import compact_date, contains_any


def provider_open_dates(raw_calendar: DataFrame) -> DataFrame:
    return (
        raw_calendar.filter(F.col("is_open").try_cast("bigint") == 1)
        .select(compact_date("cal_date").alias("trade_date")).dropna().distinct()
    )


def local_open_dates(calendar: DataFrame) -> DataFrame:
    return calendar.filter(F.col("is_trading_day")).select(F.col("trade_date").cast("date")).dropna().distinct()


def calendar_union(*calendars: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select("trade_date") for c in calendars]).distinct()


def price_coverage(prices: DataFrame) -> DataFrame:
    """(dataset, trade_date) for the datasets that land in daily_prices, from one pass."""
    stock = F.coalesce(F.col("asset_type"), F.lit("stock")) == "stock"
    seen = {"daily_prices": F.max(stock.cast("int"))}
    seen |= {d: F.max((stock & F.col(c).isNotNull()).cast("int")) for d, c in fv.PRICE_COVERAGE_FIELDS.items() if c in prices.columns}
    return _covered(prices, seen)


def flow_coverage(flow: DataFrame) -> DataFrame:
    moved = F.col("main_net_inflow_rate").isNotNull() | F.col("main_net_inflow").isNotNull()
    chips = F.coalesce(F.startswith("data_method", F.lit(fv.CHIP_METHOD)), F.lit(False))
    return _covered(flow, {"moneyflow_dc": F.max(moved.cast("int")), "cyq_perf": F.max(chips.cast("int"))})


def generic_coverage(frame: DataFrame, dataset: str) -> DataFrame:
    return frame.select(F.lit(dataset).alias("dataset"), "trade_date").dropna().distinct()


def benchmark_coverage(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """A date counts only when every benchmark has a row."""
    required = len(set(symbols))
    rows = prices.filter((F.col("asset_type") == "index") & F.col("symbol").isin(symbols))
    return (
        rows.groupBy("trade_date").agg(F.countDistinct("symbol").alias("present_"))
        .filter(F.col("present_") >= required)
        .select(F.lit("index_daily").alias("dataset"), "trade_date")
    )


def _covered(frame: DataFrame, seen: dict) -> DataFrame:
    per_date = frame.filter(F.col("trade_date").isNotNull()).groupBy("trade_date").agg(
        *[flag.alias(name) for name, flag in seen.items()]
    )
    entries = F.array(*[F.struct(F.lit(n).alias("dataset"), F.col(n).alias("hit_")) for n in seen])
    return per_date.select("trade_date", F.inline(entries)).filter("hit_ = 1").select("dataset", "trade_date")


def missing_dates(calendar: DataFrame, datasets: list[str], covered: DataFrame, start=None, end=None) -> DataFrame:
    """(dataset, trade_date) open in the window but not covered."""
    window = calendar
    if start is not None:
        window = window.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        window = window.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    wanted = window.select("trade_date", F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))
    return wanted.join(covered, ["dataset", "trade_date"], "left_anti").select("dataset", "trade_date")


def sync_start(calendar: DataFrame, covered: DataFrame) -> DataFrame:
    """First open date after the dataset that is furthest behind; else the last open date.

    Without any covered dataset: the first open date."""
    behind = covered.groupBy("dataset").agg(F.max("trade_date").alias("last_")).agg(F.min("last_").alias("behind_"))
    return calendar.agg(
        F.min("trade_date").alias("first_"), F.max("trade_date").alias("latest_"),
        F.min(F.when(F.col("trade_date") > behind.scalar(), F.col("trade_date"))).alias("next_"),
    ).select(
        F.when(behind.scalar().isNull(), F.col("first_"))
        .otherwise(F.coalesce("next_", "latest_")).alias("start_date")
    )


def calendar_fetch_start(calendar: DataFrame, end: str, lookback_days: int) -> DataFrame:
    """Earlier of the day after the last local date and the look-back date."""
    if lookback_days <= 0:
        raise ValueError("lookback_days must be positive")
    fallback = F.date_sub(F.lit(end).cast("date"), lookback_days)
    return calendar.agg(
        F.least(F.date_add(F.max("trade_date"), 1), fallback).alias("fetch_start")
    )


def active_symbols(security: DataFrame) -> DataFrame:
    rows = security.filter(F.col("status") == "active") if "status" in security.columns else security
    return rows.select("symbol").dropna().distinct()


def work_list(datasets: list[str], days: DataFrame, symbols: DataFrame, batch_size: int, batched=("moneyflow_dc",)) -> DataFrame:
    """Requests to make: dataset x date, and for `batched` datasets x symbol range.

    The ranges depend only on the number of symbols, so they are generated per date
    from one counted value; the symbol list itself is never multiplied.
    """
    counted = symbols.agg(F.count(F.lit(1)).alias("n_")).scalar()
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_") - 1, F.lit(0)), F.lit(batch_size).cast("bigint"))
    chunks = F.transform(
        F.filter(starts, lambda s: s < F.col("n_")),
        lambda s: F.struct(s.alias("symbol_start"), F.least(s + F.lit(batch_size), F.col("n_")).alias("symbol_end")),
    )
    whole = F.array(F.struct(
        F.lit(None).cast("bigint").alias("symbol_start"), F.lit(None).cast("bigint").alias("symbol_end")
    ))
    per_dataset = days.select(
        "trade_date", F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset")
    ).withColumn("n_", counted)
    return per_dataset.select(
        "dataset", "trade_date",
        F.inline(F.when(F.col("dataset").isin(list(batched)), chunks).otherwise(whole)),
    )


def span_work_list(dataset: str, start: str | None, end: str | None, symbols: DataFrame, batch_size: int) -> DataFrame:
    """Requests over a span of dates without a date of their own: one per range of symbols."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    one = symbols.agg(F.count(F.lit(1)).alias("n_"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_") - 1, F.lit(0)), F.lit(batch_size).cast("bigint"))
    ranges = one.select("n_", F.explode(starts).alias("symbol_start")).filter("symbol_start < n_")
    return ranges.select(
        F.lit(dataset).alias("dataset"), F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"),
        "symbol_start", F.least(F.col("symbol_start") + batch_size, F.col("n_")).alias("symbol_end"),
    )


def span_not_found(requested: DataFrame, results: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Results plus one row per requested ts_code without any, dated at the end of the window asked for."""
    compact = lambda day: F.date_format(F.lit(day).cast("date"), "yyyyMMdd")
    until = compact(end or start)
    window = {"trade_date": until, "request_start_date": compact(start), "request_end_date": until}
    return with_not_found(results, requested.select("ts_code").distinct(), ["ts_code"], window)


def with_not_found(results: DataFrame, requested: DataFrame, key: list[str], noted: dict | None = None) -> DataFrame:
    """Results plus one placeholder per requested key without any result; `noted` columns are set on these."""
    found = results.withColumn("provider_status", F.lit("found")) if "provider_status" not in results.columns else results
    empty = (
        requested.join(results.select(*key), key, "left_anti")
        .withColumns({"provider_status": F.lit("not_found"), "provider_message": F.lit("empty_result"), **(noted or {})})
    )
    return found.unionByName(empty, allowMissingColumns=True)


def run_statistics(tasks: DataFrame, per: list[str] = ()) -> DataFrame:
    return tasks.groupBy(*per).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") != "success").alias("remaining"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
    )


def classify_error(message) -> tuple:
    """(reason, retryable); rate limits are recognised before permissions."""
    text = F.lower(F.col(message) if isinstance(message, str) else message)
    limited = contains_any(text, fv.RATE_LIMIT_WORDS)
    denied = contains_any(text, fv.PERMISSION_WORDS)
    reason = F.when(limited, "rate_limit").when(denied, "permission_denied").otherwise("unknown")
    return reason, F.coalesce(limited, F.lit(False))
