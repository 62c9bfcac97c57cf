"""Trades: T+1 entry, forward returns, rebalance dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import by_symbol, growth
from ..plans.runtime import materialise
from .indicators import adjust_prices
from .ranking import top_per_group
from .signals import candidate_order


def entry_exit(prices: DataFrame, holding_days: int) -> DataFrame:
    """Entry at the next row's open (else close), exit `holding_days` rows later."""
    if holding_days <= 0:
        raise ValueError("holding_days must be positive")
    adjusted = adjust_prices(prices)
    w = by_symbol()

    def ahead(name, rows):
        return F.lead(name, rows).over(w)

    raw_entry, entry = ahead("close", 1), ahead("adj_close", 1)
    if "open" in prices.columns:
        raw_entry, entry = F.coalesce(ahead("open", 1), raw_entry), F.coalesce(ahead("adj_open", 1), entry)
    out = holding_days + 1
    return adjusted.select(
        "symbol",
        "trade_date",
        ahead("trade_date", 1).alias("recommend_trade_date"),
        raw_entry.alias("raw_entry_price"),
        entry.alias("entry_price"),
        ahead("trade_date", out).alias("exit_trade_date"),
        ahead("close", out).alias("raw_exit_price"),
        ahead("adj_close", out).alias("exit_price"),
    )


def forward_returns(prices: DataFrame, holding_days: int) -> DataFrame:
    return entry_exit(prices, holding_days).withColumn(
        "forward_return", growth(F.col("exit_price"), F.col("entry_price"))
    )


def signal_trades(candidates: DataFrame, prices: DataFrame, holding_days: int, top: int) -> DataFrame:
    """Best `top` candidates per date; a row without a complete exit still uses its place."""
    best = top_per_group(candidates, ["trade_date"], candidate_order(), top, "place")
    return best.join(forward_returns(prices, holding_days), ["symbol", "trade_date"], "left").filter(
        F.col("forward_return").isNotNull()
    )


def rebalance_dates(days: DataFrame, rebalance: str) -> DataFrame:
    dates = days.select("trade_date").distinct()
    if rebalance == "daily":
        return dates
    if rebalance != "weekly":
        raise ValueError("rebalance must be daily or weekly")
    return dates.groupBy(F.date_trunc("week", "trade_date").alias("week_")).agg(
        F.min("trade_date").alias("trade_date")
    ).drop("week_")


def holding_days_of(rebalance: str) -> int:
    return 1 if rebalance == "daily" else 5


def score_order():
    return [F.col("total_score").desc_nulls_first(), F.col("symbol").asc()]


def factor_trades(factors: DataFrame, prices: DataFrame, rebalance: str, top: int) -> DataFrame:
    """The best of each date are few: written once, they tell which dates and whose prices are needed."""
    dates = rebalance_dates(factors, rebalance)
    tradable = factors.filter(F.coalesce("tradable_flag", F.lit(False)))
    best = materialise(top_per_group(tradable, ["trade_date"], score_order(), top, "place"), "best-of-dates").join(
        dates, "trade_date", "left_semi")
    held = prices.join(best.select("symbol").distinct(), "symbol", "left_semi")  # whole histories
    exits = forward_returns(held, holding_days_of(rebalance))
    return best.join(exits, ["symbol", "trade_date"], "left").filter(F.col("forward_return").isNotNull())
