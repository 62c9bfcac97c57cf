"""Factor evaluation: IC, quantile returns, coverage, correlation.

All factors and dates are evaluated by one plan instead of one at a time. Ranks are taken from
wide rows, a day's rows together in one task; days too large for that, and rows that come as
(symbol, trade_date, factor, value), are ranked over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrow_tasks import MOMENT_COLUMNS, day_figures, pair_moments
from ..functions.columns import pair_correlation, ratio
from ..functions.fixed_values import EVALUATED_FACTORS
from ..plans.runtime import materialise
from .ranking import crowded_days, day_layout, long_average_rank, ordinal_rank, split_days, unpivot
from .trades import forward_returns

MIN_PAIRS = 3
_GROUP = ["factor", "trade_date"]
_FIGURES = "factor string, trade_date date, `group` bigint, sample_count bigint, ic double, rank_ic double, return_sum double"


def paired(factors: DataFrame, prices: DataFrame, forward_days: int, columns=EVALUATED_FACTORS, wide: bool = False) -> DataFrame:
    """Factor values that have a forward return, long or with the factors beside each other.

    The join runs on the wide rows, before the unpivot multiplies them.
    """
    if forward_days <= 0:
        raise ValueError("forward_days must be positive")
    returns = forward_returns(prices, forward_days).select("symbol", "trade_date", "forward_return")
    joined = factors.select("symbol", "trade_date", *columns).join(
        returns.filter(F.col("forward_return").isNotNull()), ["symbol", "trade_date"]
    )
    keep = ["symbol", "trade_date", "forward_return"]
    return joined.select(*keep, *columns) if wide else unpivot(joined, list(columns), keep)


def figures_by_day(
    pairs: DataFrame, ic: bool = True, groups: int | None = None, stored: bool = False, crowded: list | None = None
) -> DataFrame:
    """Per factor and date its correlations (group null) and the return sums of its quantile groups.

    `pairs` are long or wide. `crowded` are the days of wide rows to rank over many tasks, if known."""
    if groups is not None and groups < 2:
        raise ValueError("groups must be >= 2")
    if "factor" in pairs.columns:
        return _figures_of_long(pairs, ic, groups, stored)
    rows, large = split_days(pairs, crowded_days(pairs) if crowded is None else crowded)
    columns = [c for c in pairs.columns if c not in ("symbol", "trade_date", "forward_return")]
    found = day_layout(rows, "trade_date", "symbol").select(
        "place_", "again_", "trade_date", *[F.col(c).cast("double").alias(c) for c in ("forward_return", *columns)]
    ).mapInArrow(day_figures(columns, MIN_PAIRS, ic, groups), _FIGURES)
    if large is None:
        return found
    return found.unionByName(_figures_of_long(unpivot(large, columns, ["symbol", "trade_date", "forward_return"]), ic, groups, False))


def _figures_of_long(pairs: DataFrame, ic: bool, groups: int | None, stored: bool) -> DataFrame:
    pairs = pairs if stored or not (ic and groups) else materialise(pairs, "factor-pairs")
    stored = stored or (ic and bool(groups))
    parts = []
    if ic:
        ranked = ordinal_rank(pairs, _GROUP, "value", ["symbol"], "value_rank", stored)
        ranked = ordinal_rank(ranked, _GROUP, "forward_return", ["symbol"], "return_rank", stored=True)
        rank = lambda name: F.col(name).cast("double")
        parts.append(ranked.groupBy(*_GROUP).agg(
            pair_correlation(F.col("value"), F.col("forward_return")).alias("ic"),
            pair_correlation(rank("value_rank"), rank("return_rank")).alias("rank_ic"),
            F.count(F.lit(1)).alias("sample_count"),
        ).filter(F.col("sample_count") >= MIN_PAIRS).withColumns(
            {"group": F.lit(None).cast("bigint"), "return_sum": F.lit(None).cast("double")}))
    if groups:
        ranked = long_average_rank(pairs, _GROUP, "value", ["symbol"], stored)
        share = (F.col("avg_rank") - F.lit(1.0)) / F.col("group_size") * F.lit(groups)
        bucket = F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(groups - 1))
        parts.append(ranked.groupBy(*_GROUP, bucket.alias("group")).agg(
            F.sum("forward_return").alias("return_sum"), F.count(F.lit(1)).alias("sample_count"),
        ).withColumns({"ic": F.lit(None).cast("double"), "rank_ic": F.lit(None).cast("double")}))
    names = [field.split()[0].strip("`") for field in _FIGURES.split(", ")]
    return reduce(DataFrame.unionByName, [part.select(*names) for part in parts])


def ic_of(figures: DataFrame) -> DataFrame:
    return figures.filter(F.col("group").isNull()).select(*_GROUP, "ic", "rank_ic", "sample_count")


def group_returns_of(figures: DataFrame) -> DataFrame:
    return figures.filter(F.col("group").isNotNull()).groupBy("factor", "group").agg(
        (F.sum("return_sum") / F.sum("sample_count")).alias("avg_forward_return"), F.sum("sample_count").alias("sample_count")
    )


def ic_by_date(pairs: DataFrame, stored: bool = False, crowded: list | None = None) -> DataFrame:
    """Pearson and rank correlation per factor and date; dates with too few pairs are left out."""
    return ic_of(figures_by_day(pairs, stored=stored, crowded=crowded))


def ic_only(pairs: DataFrame) -> DataFrame:
    """Pearson IC alone: one aggregate, combined before the shuffle, no ranks."""
    return (
        pairs.groupBy(*_GROUP)
        .agg(
            pair_correlation(F.col("value"), F.col("forward_return")).alias("ic"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .filter(F.col("sample_count") >= MIN_PAIRS)
    )


def group_returns(pairs: DataFrame, groups: int, stored: bool = False, crowded: list | None = None) -> DataFrame:
    """Mean forward return per factor and quantile group over all dates."""
    return group_returns_of(figures_by_day(pairs, False, groups, stored, crowded))


def coverage(factors: DataFrame, columns=EVALUATED_FACTORS) -> DataFrame:
    counted = factors.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(c) for c in columns])
    entries = F.array(
        *[F.struct(F.lit(c).alias("factor"), F.col(c).alias("non_null_count")) for c in columns]
    )
    return counted.select(F.inline(entries), "row_count").withColumn(
        "coverage", F.coalesce(ratio(F.col("non_null_count"), F.col("row_count")), F.lit(0.0))
    )


def correlation(factors: DataFrame, columns=EVALUATED_FACTORS) -> DataFrame:
    """Pairwise-complete correlation, long form, from one pass over the factor table.

    Every task reduces its rows to one line per pair (counts, means, centred sums); the
    lines are then combined the way variances of parts are. As SQL this takes some 800
    aggregation buffers per row, which is beyond generated code. Constant sides give null.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    schema = ", ".join(f"{c} {'int' if c == 'pair' else 'double'}" for c in MOMENT_COLUMNS)
    parts = factors.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(
        pair_moments(columns), schema
    )
    # centre each part on the mean of its pair, so that large means do not cancel out
    pair = Window.partitionBy("pair")
    n = F.col("n")
    gap_x, gap_y = [
        F.col(c) - F.sum(n * F.col(c)).over(pair) / F.sum("n").over(pair) for c in ("mean_x", "mean_y")
    ]
    centred = parts.withColumns({"gap_x": gap_x, "gap_y": gap_y})
    between = lambda own, s, t: F.sum(F.col(own) + n * F.col(s) * F.col(t))
    summed = centred.groupBy("pair").agg(
        between("sxx", "gap_x", "gap_x").alias("sxx"), between("syy", "gap_y", "gap_y").alias("syy"),
        between("sxy", "gap_x", "gap_y").alias("sxy"),
        (F.min("min_x") == F.max("max_x")).alias("flat_x"), (F.min("min_y") == F.max("max_y")).alias("flat_y"),
    )
    spread = F.sqrt("sxx") * F.sqrt("syy")
    value = F.when(~F.col("flat_x") & ~F.col("flat_y"), ratio(F.col("sxy"), spread))
    found = summed.select("pair", value.alias("correlation"))
    # both orders of every pair, also of pairs without a common row
    named = factors.sparkSession.createDataFrame(
        [(i, a, b) for i, p in enumerate(pairs) for a, b in dict.fromkeys([p, p[::-1]])],
        "pair int, factor string, other string",
    )
    return named.join(found, "pair", "left").select("factor", "other", "correlation")


def correlation_matrix(factors: DataFrame, columns=EVALUATED_FACTORS) -> DataFrame:
    return (
        correlation(factors, columns).groupBy("factor").pivot("other", list(columns)).agg(F.first("correlation"))
    )


def ic_summary(by_date: DataFrame) -> DataFrame:
    return by_date.groupBy("factor").agg(
        F.avg("ic").alias("mean_ic"),
        ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"),
        F.count(F.lit(1)).alias("date_count"),
    )
