"""Held dates as one bit mask per dataset, symbol and month.

Bit d - 1 of `days` says that the symbol has day d of `month`. A mask is four bytes for up to
31 rows, masks of parts combine by bit_or in any order and any number of times, and questions
about dates per symbol read masks instead of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv

KEY = ["dataset", "symbol", "month"]


def _day_bit() -> Column:
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth("trade_date") - 1)


def _masks(rows: DataFrame, held: dict[str, Column], keep: list[str]) -> DataFrame:
    """One mask per dataset from one aggregate, combined before its shuffle; `held` says which rows count."""
    known = rows.filter(F.col("trade_date").isNotNull() & F.col("symbol").isNotNull())
    month = F.trunc("trade_date", "month").alias("month")
    masks = known.groupBy(*keep, "symbol", month).agg(*[F.bit_or(F.when(hit, _day_bit())).alias(name) for name, hit in held.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("dataset"), F.col(name).alias("days")) for name in held])
    return masks.select(*keep, "symbol", "month", F.inline(entries)).filter(F.col("days").isNotNull()).select(*keep, *KEY, "days")


def price_masks(prices: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(keep..., dataset, symbol, month, days) of the datasets that land in the price table."""
    stock = F.coalesce(F.col("asset_type"), F.lit("stock")) == "stock"
    held = {"daily_prices": stock}
    held |= {d: stock & F.col(c).isNotNull() for d, c in fv.PRICE_COVERAGE_FIELDS.items() if c in prices.columns}
    return _masks(prices, held, list(keep))


def flow_masks(flow: DataFrame, keep: list[str] = ()) -> DataFrame:
    moved = F.col("main_net_inflow_rate").isNotNull() | F.col("main_net_inflow").isNotNull()
    chips = F.coalesce(F.startswith("data_method", F.lit(fv.CHIP_METHOD)), F.lit(False))
    return _masks(flow, {"moneyflow_dc": moved, "cyq_perf": chips}, list(keep))


def combined(*parts: DataFrame) -> DataFrame:
    """One mask per dataset, symbol and month of masks that may repeat or overlap."""
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.bit_or("days").alias("days"))


def _dates(days: Column) -> Column:
    """The dates of `month` whose bit is set."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda d: F.getbit(days, d) == 1)
    return F.transform(numbers, lambda d: F.date_add(F.col("month"), d))


def covered_dates(masks: DataFrame) -> DataFrame:
    """(dataset, trade_date) held by any symbol."""
    months = masks.groupBy("dataset", "month").agg(F.bit_or("days").alias("days"))
    return months.select("dataset", F.explode(_dates(F.col("days"))).alias("trade_date"))


def missing_by_symbol(calendar: DataFrame, datasets: list[str], symbols: DataFrame, masks: DataFrame, start=None, end=None) -> DataFrame:
    """(dataset, symbol, trade_date) open in the window and not held by the symbol.

    The calendar is a value, one mask a month, given to every symbol; a month that a symbol holds whole makes no row.
    Repeated symbols count once, null ones not; without open dates nothing is missing."""
    days = calendar.filter(F.col("trade_date").isNotNull())
    if start is not None:
        days = days.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    months = days.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.bit_or(_day_bit()).alias("open_"))
    all_months = months.agg(F.collect_list(F.struct("month", "open_")).alias("months_")).scalar()
    wanted = (
        symbols.select("symbol").dropna().distinct()
        .select("symbol", F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))
        .select("symbol", "dataset", F.inline(all_months))
    )
    lacking = F.col("open_").bitwiseAND(F.bitwise_not(F.coalesce(F.col("days"), F.lit(0))))
    return (
        wanted.join(combined(masks), KEY, "left").withColumn("lacking_", lacking).filter("lacking_ <> 0")
        .select("dataset", "symbol", F.explode(_dates(F.col("lacking_"))).alias("trade_date"))
    )
