"""Trade and portfolio statistics.

The portfolio series has one row per signal date (and parameter set). Every window
over it is partitioned by the `group` columns, so sweeps run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_symbol, growth, ratio
from ..functions.fixed_values import DEFAULT_BENCHMARK, TRADING_DAYS_PER_YEAR
from .indicators import adjust_prices
from .ranking import top_per_group
from .selection import MOST_ROWS, exact_median
from .signals import candidate_order
from .trades import forward_returns


def trade_metrics(trades: DataFrame, group: list[str] = (), most_rows: int = MOST_ROWS) -> DataFrame:
    """Measures of the trades of each group; `trades` is read more than once.

    Where a group has more than `most_rows` trades, medians are selected over range parts, else found inside the aggregate;
    both are exact."""
    result = F.col("forward_return")
    measures = [
        F.count(F.lit(1)).alias("trade_count"),
        F.countDistinct("trade_date").alias("signal_dates"),
        F.avg(result).alias("avg_forward_return"),
        F.median(result).alias("median_forward_return"),
        F.avg((result > 0).cast("double")).alias("win_rate"),
        F.max(result).alias("best_trade_return"),
        F.min(result).alias("worst_trade_return"),
        F.stddev_samp(result).alias("return_std"),
    ]
    largest = trades.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if largest is None or largest <= most_rows:
        return trades.groupBy(*group).agg(*measures)
    rest = trades.groupBy(*group).agg(*[m for i, m in enumerate(measures) if i != 3])
    middle = exact_median(trades, "forward_return", list(group), most_rows=most_rows).withColumnsRenamed(
        {"median": "median_forward_return", **{c: f"{c}_m" for c in group}})
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_m"))
    joined = rest.join(middle, on, "left") if group else rest.withColumn("median_forward_return", middle.select("median_forward_return").scalar())
    return joined.select(*group, "trade_count", "signal_dates", "avg_forward_return", "median_forward_return", "win_rate",
                         "best_trade_return", "worst_trade_return", "return_std")


def portfolio_returns(trades: DataFrame, group: list[str] = ()) -> DataFrame:
    """Equal-weight return per date with the held symbols (at most `top` of them)."""
    return trades.groupBy(*group, "trade_date").agg(
        F.avg("forward_return").alias("portfolio_return"),
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
    )


def compound(column) -> Column:
    return F.product(F.lit(1.0) + F.col(column)) - F.lit(1.0)


def _periods(holding_days) -> Column:
    return F.lit(float(TRADING_DAYS_PER_YEAR)) / (F.lit(holding_days) if isinstance(holding_days, int) else holding_days)


def drawdowns(portfolio: DataFrame, group: list[str] = ()) -> DataFrame:
    """Distance of the equity curve from its running peak; both start at 1."""
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("trade_date")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        portfolio.withColumn("equity", F.product(F.lit(1.0) + F.col("portfolio_return")).over(so_far))
        .withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far)))
        .withColumn("drawdown", F.least(F.lit(0.0), F.col("equity") / F.col("peak") - F.lit(1.0)))
    )


def return_metrics(portfolio: DataFrame, holding_days, group: list[str] = ()) -> DataFrame:
    """Annualised return and volatility, Sharpe, drawdown, Calmar."""
    per_year = _periods(holding_days)
    summed = drawdowns(portfolio, group).groupBy(*group).agg(
        compound("portfolio_return").alias("total_return"),
        F.count(F.lit(1)).alias("period_count"),
        F.coalesce(F.stddev_samp("portfolio_return"), F.lit(0.0)).alias("deviation_"),
        F.min("drawdown").alias("max_drawdown"),
    ).filter(F.col("period_count") > 0)
    total = F.col("total_return")
    annual = F.when(
        total > -1, F.pow(F.lit(1.0) + total, per_year / F.col("period_count")) - F.lit(1.0)
    ).otherwise(F.lit(-1.0))
    return (
        summed.withColumn("annual_return", annual)
        .withColumn("annual_volatility", F.col("deviation_") * F.sqrt(per_year))
        .withColumn("sharpe_ratio", ratio(F.col("annual_return"), F.col("annual_volatility")))
        .withColumn("calmar_ratio", ratio(F.col("annual_return"), F.abs("max_drawdown")))
        .drop("deviation_")
    )


def turnover(portfolio: DataFrame, group: list[str] = ()) -> DataFrame:
    """Mean turnover and mean Jaccard overlap of consecutive holdings."""
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("trade_date")
    current, before = F.col("symbols"), F.col("before_")
    kept = F.size(F.array_intersect(current, before))
    return (
        portfolio.withColumn("before_", F.lag("symbols").over(order))
        .groupBy(*group)
        .agg(
            F.avg(F.when(before.isNotNull(), F.lit(1.0) - kept / F.size(current))).alias("turnover_proxy"),
            F.avg(F.when(before.isNotNull(), kept / F.size(F.array_union(current, before)))).alias("holding_overlap"),
        )
    )


def monthly_returns(portfolio: DataFrame, group: list[str] = ()) -> DataFrame:
    return portfolio.groupBy(*group, F.date_format("trade_date", "yyyy-MM").alias("month")).agg(
        compound("portfolio_return").alias("monthly_return")
    )


def benchmark_list(symbols=None) -> list[str]:
    """Ordered distinct benchmarks; the first one is the primary."""
    named = [symbols] if isinstance(symbols, str) else list(symbols or [])
    return list(dict.fromkeys(s for s in named if s)) or [DEFAULT_BENCHMARK]


def benchmark_returns(prices: DataFrame, benchmarks: list[str], holding_days: int) -> DataFrame:
    """Forward return of each benchmark on its own rows.

    Only benchmark rows pass the filter, which reaches the scan.
    """
    rows = prices.filter(F.col("symbol").isin(benchmarks))
    return forward_returns(rows, holding_days).select(
        F.col("symbol").alias("benchmark_symbol"), "trade_date", F.col("forward_return").alias("benchmark_return")
    )


def matched_returns(portfolio: DataFrame, benchmarks: list[str], returns: DataFrame, group: list[str] = ()) -> DataFrame:
    """One row per benchmark and signal date; benchmark_return is null when unmatched."""
    named = F.inline(F.array(*[
        F.struct(F.lit(symbol).alias("benchmark_symbol"), F.lit(place).alias("position"))
        for place, symbol in enumerate(benchmarks, start=1)
    ]))
    return portfolio.select(*group, "trade_date", "portfolio_return", named).join(
        returns, ["benchmark_symbol", "trade_date"], "left"
    )


def benchmark_metrics(matched: DataFrame, holding_days, group: list[str] = ()) -> DataFrame:
    """Benchmark and excess compound return, tracking error, information ratio per benchmark."""
    per_year = _periods(holding_days)
    hit = F.col("benchmark_return").isNotNull()
    excess = F.when(hit, F.col("portfolio_return") - F.col("benchmark_return"))
    matched_count = F.count("benchmark_return")

    def compounded(value):
        return F.product(F.when(hit, F.lit(1.0) + value)) - F.lit(1.0)

    return (
        matched.groupBy(*group, "benchmark_symbol", "position")
        .agg(
            compounded(F.col("benchmark_return")).alias("benchmark_return"),
            compounded(F.col("portfolio_return")).alias("matched_return_"),
            F.when(matched_count > 0, F.coalesce(F.stddev_samp(excess), F.lit(0.0))).alias("deviation_"),
            F.avg(excess).alias("mean_"),
            F.sum(F.when(hit, 0).otherwise(1)).alias("missing_dates"),
        )
        .withColumn("excess_return", F.col("matched_return_") - F.col("benchmark_return"))
        .withColumn("tracking_error", F.col("deviation_") * F.sqrt(per_year))
        .withColumn("information_ratio", ratio(F.col("mean_") * per_year, F.col("tracking_error")))
        .drop("matched_return_", "deviation_", "mean_")
    )


def sweep(candidates: DataFrame, prices: DataFrame, holding_days: list[int], top: list[int]) -> DataFrame:
    """Return metrics of every (holding_days, top) pair in one job.

    Candidates are ranked once up to the largest `top`, prices are windowed once per
    holding period inside the same exchange, and the settings travel as literals.
    """
    widest = top_per_group(candidates, ["trade_date"], candidate_order(), max(top), "place")
    exits = [
        F.struct(F.lit(days).alias("holding_days"), F.col(f"r{days}_").alias("forward_return"))
        for days in holding_days
    ]
    returns = _returns_for(prices, holding_days)
    rows = (
        widest.join(returns, ["symbol", "trade_date"], "left")
        .select("symbol", "trade_date", "place", F.inline(F.array(*exits)))
        .filter(F.col("forward_return").isNotNull())
    )
    sized = rows.withColumn("top", F.explode(F.array(*[F.lit(t) for t in top]))).filter("place <= top")
    keys = ["holding_days", "top"]
    portfolio = portfolio_returns(sized, keys)
    return return_metrics(portfolio, F.col("holding_days"), keys)


def _returns_for(prices: DataFrame, holding_days: list[int]) -> DataFrame:
    w = by_symbol()
    entry = F.coalesce(F.lead("adj_open", 1).over(w), F.lead("adj_close", 1).over(w))
    return adjust_prices(prices).select(
        "symbol", "trade_date",
        *[growth(F.lead("adj_close", d + 1).over(w), entry).alias(f"r{d}_") for d in holding_days],
    )
