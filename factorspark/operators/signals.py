"""Signal strategy 001: flow, golden cross and profit ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import is_st_name
from .indicators import adjust_prices, change_over, with_macd
from .ranking import ordinal_rank, top_per_group

# Thresholds of the signal
MIN_INFLOW_RATE = 0
MIN_PROFIT_RATIO = 80


def candidates(prices: DataFrame, flow: DataFrame, security: DataFrame) -> DataFrame:
    """Rows passing every condition of the signal.

    The price history is cut to the four columns the signal needs before Python
    sees it. Row conditions come after the average, which needs all rows.
    """
    history = (
        adjust_prices(prices)
        .withColumn("return_20d", change_over("adj_close", 20))
        .select("symbol", "trade_date", "close", "amount", "adj_close", "return_20d")
    )
    crossed = with_macd(history).filter(
        F.col("macd_golden_cross") & F.col("close").isNotNull() & (F.col("amount") > 0)
    )
    inflows = flow.filter(
        (F.col("main_net_inflow_rate") > MIN_INFLOW_RATE) & (F.col("close_profit_ratio") > MIN_PROFIT_RATIO)
    ).select("symbol", "trade_date", "main_net_inflow_rate", "close_profit_ratio")
    tradable = (
        security.filter((F.col("status") == "active") & ~is_st_name()).select("symbol", "name", "status")
    )
    return crossed.join(inflows, ["symbol", "trade_date"]).join(tradable, "symbol")


def candidate_order() -> list[Column]:
    """Strongest first. A missing 20-row return sorts ahead; symbol settles ties."""
    return [
        F.col("main_net_inflow_rate").desc_nulls_first(),
        F.col("close_profit_ratio").desc_nulls_first(),
        F.col("return_20d").desc_nulls_first(),
        F.col("symbol").asc(),
    ]


def date_successors(days: DataFrame) -> DataFrame:
    """(trade_date, recommend_trade_date): each date with the next one.

    One row per calendar date, so the single window partition is bounded by the
    calendar, whatever the number of securities.
    """
    opened = days.filter(F.coalesce("is_trading_day", F.lit(False))) if "is_trading_day" in days.columns else days
    return (
        opened.select("trade_date").distinct()
        .withColumn("recommend_trade_date", F.lead("trade_date").over(Window.orderBy("trade_date")))
    )


def on_latest_price_date(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows of the last date of the price table, found by a scalar subquery."""
    latest = prices.agg(F.max("trade_date").alias("latest")).scalar()
    return rows.filter(F.col("trade_date") == latest)


def reason() -> Column:
    return F.concat(F.lit(fv.RANKING_REASON), _fixed(F.col("close_profit_ratio"), 2))


def detailed_reason() -> Column:
    return F.concat(F.lit(fv.DETAILED_REASON), _fixed(F.col("close_profit_ratio"), 2))


def _fixed(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast("string")


def factor_value() -> Column:
    def part(name, digits):
        return F.concat(F.lit(f"{name}="), F.coalesce(_fixed(F.col(name), digits), F.lit("null")))

    crossed = F.coalesce(F.col("macd_golden_cross"), F.lit(False)).cast("string")
    return F.concat_ws(
        "; ",
        part("main_net_inflow_rate", 4),
        F.concat(F.lit("macd_golden_cross="), crossed),
        part("close_profit_ratio", 4),
        part("return_20d", 6),
    )


def ranking(rows: DataFrame, successors: DataFrame, top: int) -> DataFrame:
    """Best `top` candidates of each date present in `rows`."""
    best = top_per_group(rows, ["trade_date"], candidate_order(), top, "rank")
    return (
        best.join(successors, "trade_date", "left")
        .withColumn("reason", reason())
        .withColumnRenamed("trade_date", "signal_date")
        .select(*fv.RANKING_COLUMNS)
    )


def explained_ranking(rows: DataFrame, successors: DataFrame, top: int) -> DataFrame:
    return (
        ranking(rows, successors, top)
        .withColumns({"factor_value": factor_value(), "reason": detailed_reason()})
        .drop("macd_golden_cross")
    )


def pass_table(rows: DataFrame, successors: DataFrame) -> DataFrame:
    """All passing rows of each date with one flag per condition, ranked without a cut."""
    inverted = rows.withColumns(
        {
            "order_": F.struct(
                -F.col("main_net_inflow_rate"),
                -F.col("close_profit_ratio"),
                F.col("return_20d").isNotNull(),
                -F.coalesce("return_20d", F.lit(0.0)),
            )
        }
    )
    ranked = ordinal_rank(inverted, ["trade_date"], "order_", ["symbol"], "factor_rank")
    return (
        ranked.drop("order_").join(successors, "trade_date", "left")
        .withColumns(
            {
                "pass_main_net_inflow_rate": F.col("main_net_inflow_rate") > MIN_INFLOW_RATE,
                "pass_macd_golden_cross": F.coalesce("macd_golden_cross", F.lit(False)),
                "pass_close_profit_ratio": F.col("close_profit_ratio") > MIN_PROFIT_RATIO,
                "pass_exclude_st": F.lit(True),
                "factor_pass": F.lit(True),
                "factor_value": factor_value(),
                "reason": detailed_reason(),
            }
        )
        .withColumnRenamed("trade_date", "signal_date")
        .select(*fv.PASS_COLUMNS)
    )
