"""Column expressions. All of them stay inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, functions as F

from . import fixed_values as fv


def by_symbol():
    """Row order of one security. At most one row per calendar date."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def lenient_double(column) -> Column:
    return F.col(column).try_cast("double") if isinstance(column, str) else column.try_cast("double")


def compact_date(column) -> Column:
    """yyyyMMdd text or number -> date; anything else -> null."""
    text = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    well_formed = text.rlike("^[0-9]{8}$")
    return F.when(well_formed, F.try_to_date(text, "yyyyMMdd"))


def iso_date(column) -> Column:
    """yyyy-MM-dd text, or a date -> date; anything else -> null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(numerator, denominator)


def growth(later: Column, earlier: Column) -> Column:
    return ratio(later, earlier) - F.lit(1.0)


def is_st_name(name="name") -> Column:
    return F.coalesce(F.col(name), F.lit("")).rlike(fv.ST_NAME_PATTERN)


def rolling(aggregate, column: Column, rows: int) -> Column:
    """Trailing aggregate, null until `rows` non-null values are in the frame."""
    frame = by_symbol().rowsBetween(1 - rows, Window.currentRow)
    return F.when(F.count(column).over(frame) >= rows, aggregate(column).over(frame))


def unit_clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def short_hash(value) -> Column:
    text = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))
    return F.when(F.length(text) > 16, F.concat(F.substring(text, 1, 12), F.lit("..."))).otherwise(text)


def pair_correlation(left: Column, right: Column) -> Column:
    """Pearson over rows where both sides are present; null when a side is constant."""
    a = F.when(right.isNotNull(), left)
    b = F.when(left.isNotNull(), right)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
