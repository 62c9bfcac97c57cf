"""Per-security indicators.

Every window here is partitioned by symbol and ordered by trade_date, so Catalyst
plans one exchange and one sort for all of them. (symbol, trade_date) is the key
of the input, hence a partition holds at most one row per calendar date and never
grows with the number of securities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.arrow_tasks import MACD_COLUMNS, macd_of_symbols
from ..functions.columns import by_symbol, growth, ratio, rolling


def adjust_prices(prices: DataFrame) -> DataFrame:
    """Forward-adjusted adj_close and adj_open, scaled to the latest known factor."""
    opening = F.col("open") if "open" in prices.columns else F.col("close")
    if "adj_factor" not in prices.columns:
        return prices.withColumns({"adj_close": F.col("close"), "adj_open": opening})
    whole = by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latest = F.last("adj_factor", ignorenulls=True).over(whole)
    scale = F.coalesce(ratio(F.col("adj_factor"), latest), F.lit(1.0))
    return (
        prices.withColumn("adj_scale_", scale)
        .withColumns({"adj_close": F.col("close") * F.col("adj_scale_"), "adj_open": opening * F.col("adj_scale_")})
        .drop("adj_scale_")
    )


def change_over(column: str, rows: int) -> Column:
    return growth(F.col(column), F.lag(column, rows).over(by_symbol()))


def stocks_only(prices: DataFrame) -> DataFrame:
    return prices.filter(F.coalesce(F.col("asset_type"), F.lit("stock")) != "index")


def price_indicators(adjusted: DataFrame) -> DataFrame:
    """Momentum, moving-average strength, liquidity and volatility columns."""
    close, amount = F.col("adj_close"), F.col("amount")
    last_20 = by_symbol().rowsBetween(-19, Window.currentRow)
    base = adjusted.withColumns(
        {
            "daily_return": change_over("adj_close", 1),
            "mom_20": change_over("adj_close", 20),
            "mom_60": change_over("adj_close", 60),
            "ma_strength": growth(close, rolling(F.avg, close, 20)),
            "avg_amount_20": rolling(F.avg, amount, 20),
            "turnover_stability": ratio(rolling(F.stddev_samp, amount, 20), rolling(F.avg, amount, 20)),
            "high_20_": F.max(close).over(last_20),
            "closes_20_": F.count(close).over(last_20),
        }
    )
    moved = F.col("daily_return")
    # the high of 60 rows is that of three times 20
    before = lambda name: [F.col(name), *[F.lag(name, rows).over(by_symbol()) for rows in (20, 40)]]
    closes = sum((F.coalesce(c, F.lit(0)) for c in before("closes_20_")), F.lit(0))
    return base.withColumns(
        {
            "vol_20": rolling(F.stddev_samp, moved, 20),
            "downside_vol_20": rolling(F.stddev_samp, F.when(moved < 0, moved), 20),
            "max_drawdown_60": F.when(closes >= 60, growth(close, F.greatest(*before("high_20_")))),
        }
    ).drop("high_20_", "closes_20_")


def flow_indicators(flow: DataFrame) -> DataFrame:
    rate, winners = F.col("main_net_inflow_rate"), F.col("close_profit_ratio")
    return flow.select(
        "symbol",
        "trade_date",
        rolling(F.sum, rate, 5).alias("flow_5d"),
        rolling(F.sum, rate, 20).alias("flow_20d"),
        rolling(F.avg, (rate > 0).cast("double"), 10).alias("flow_persistence"),
        winners.alias("winner_rate"),
        (winners - F.lag(winners, 5).over(by_symbol())).alias("winner_rate_change_5d"),
        (winners - F.lag(winners, 20).over(by_symbol())).alias("winner_rate_change_20d"),
    )


# --- exponential averages ---------------------------------------------------

def with_macd(adjusted: DataFrame) -> DataFrame:
    """ema12, ema26, dif, dea and the golden cross.

    The average is a recurrence, which SQL windows cannot express. Python sees two columns
    of the rows as the window by symbol leaves them, many symbols per Arrow batch; the other
    columns stay in the JVM and the layout by symbol is kept.
    """
    averages = F.pandas_udf(macd_of_symbols, T.StructType([T.StructField(c, T.DoubleType()) for c in MACD_COLUMNS]))
    rows = (
        adjusted.withColumn("place_", F.row_number().over(by_symbol()))
        .sortWithinPartitions("symbol", "trade_date")  # the window's own order: no further sort
        .withColumn("macd_", averages.asNondeterministic()("place_", "adj_close"))
    )
    crossed = (F.col("macd_.prev_dif") <= F.col("macd_.prev_dea")) & (F.col("macd_.dif") > F.col("macd_.dea"))
    shown = [F.col(f"macd_.{c}").alias(c) for c in MACD_COLUMNS if not c.startswith("prev_")]
    return rows.select(*adjusted.columns, *shown, crossed.alias("macd_golden_cross"))


def change_within(days: int, key: str = "symbol") -> Column:
    """Change over the last `days` rows, in percent.

    `days` rows span days - 1 intervals; fewer than two rows give null. A missing
    close counts as zero.
    """
    frame = Window.partitionBy(key).orderBy("trade_date").rowsBetween(1 - days, Window.currentRow)
    close = F.coalesce(F.col("close"), F.lit(0.0))
    change = growth(F.last(close).over(frame), F.first(close).over(frame)) * F.lit(100.0)
    return F.when(F.count(F.lit(1)).over(frame) >= 2, change)


def period_return(rows: DataFrame, days: int, key: str = "symbol") -> DataFrame:
    """(key, trade_date, period_return)."""
    return rows.select(key, "trade_date", change_within(days, key).alias("period_return"))
