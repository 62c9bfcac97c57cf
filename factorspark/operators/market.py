"""Market status of every date at once: indexes, sectors, structural risks.

Per date there are at most six indexes and a fixed list of industries, so the small
arrays gathered here have a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..plans.runtime import materialise
from .indicators import change_within
from .pools import theme_of
from .ranking import top_per_group

# Thresholds of the summary and the risk flags
BROAD_UP, BROAD_DOWN, DIVERGENCE = 0.7, 0.3, 2.0
INDEX_DOWN, SECTOR_DOWN = 0.67, 0.60
KEPT_RISKS = 3


def index_metrics(prices: DataFrame) -> DataFrame:
    """1-day, 5-row and 20-row return of each broad index and date."""
    codes = [code for code, _ in fv.BROAD_INDEXES]
    roles = F.create_map(*[F.lit(v) for entry in fv.BROAD_INDEXES for v in entry])
    rows = prices.filter((F.col("asset_type") == "index") & F.col("symbol").isin(codes))
    return (
        rows.select(
            "symbol", "trade_date", F.coalesce("pct_change", F.lit(0.0)).alias("return_1d"),
            change_within(5).alias("return_5d"), change_within(20).alias("return_20d"),
        )
        .withColumn("role", roles[F.col("symbol")])
        .withColumn("position", F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("symbol")))
    )


def strongest_weakest(metrics: DataFrame) -> DataFrame:
    """Per date the leader and the laggard by 1-day return with a reason code.

    Equal returns keep the order of the index list: the first leads, the last lags."""
    day = Window.partitionBy("trade_date")
    five = F.coalesce("return_5d", F.lit(0.0))
    ranked = metrics.withColumn("rank_5d", F.row_number().over(day.orderBy(five.desc(), "position")))
    card = F.struct("return_1d", (-F.col("position")).alias("order_"), "symbol", "rank_5d")
    per_date = ranked.groupBy("trade_date").agg(
        F.max(card).alias("top_"), F.min(card).alias("low_"),
        F.count(F.lit(1)).alias("n_"), F.count_if(F.col("return_1d") > 0).alias("up_"),
        F.count_if(F.col("return_1d") < 0).alias("down_"),
    )
    all_up, all_down = F.col("up_") == F.col("n_"), F.col("down_") == F.col("n_")
    lead = (
        F.when(all_down, "falls_least").when(all_up, "leads_broad_rise")
        .when(F.col("top_.rank_5d") <= 2, "leads_1d_and_5d").otherwise("recovers_today")
    )
    lag = (
        F.when(all_up, "rises_least").when(all_down, "leads_broad_fall")
        .when(F.col("low_.rank_5d") >= F.greatest(F.lit(1), F.col("n_") - 1), "lags_1d_and_5d")
        .otherwise("falls_back_today")
    )
    return per_date.select(
        "trade_date",
        F.col("top_.symbol").alias("strongest"), F.col("top_.return_1d").alias("strongest_return"),
        lead.alias("strongest_reason"),
        F.col("low_.symbol").alias("weakest"), F.col("low_.return_1d").alias("weakest_return"),
        lag.alias("weakest_reason"),
    )


def sector_metrics(industry_daily: DataFrame, classification: DataFrame) -> DataFrame:
    first_level = classification.filter(
        (F.col("level") == "L1") & (F.col("source_system") == fv.CLASSIFICATION_SYSTEM)
    ).select("index_code", "industry_name")
    return industry_daily.drop("industry_name").join(first_level, "index_code")


def sector_extremes(sectors: DataFrame, keep: int = 3) -> DataFrame:
    """First and last `keep` sectors of each date by change; side is 'strong' or 'weak'."""
    change = F.coalesce("pct_change", F.lit(0.0))
    shown = sectors.select("trade_date", "index_code", "industry_name", change.alias("pct_change"))
    best = top_per_group(shown, ["trade_date"], [F.col("pct_change").desc(), F.col("index_code")], keep, "place")
    worst = top_per_group(shown, ["trade_date"], [F.col("pct_change").asc(), F.col("index_code")], keep, "place")
    return best.withColumn("side", F.lit("strong")).unionByName(worst.withColumn("side", F.lit("weak")))


def _listed(side: str) -> Column:
    """The (at most three) sectors of a side in order of place."""
    card = F.struct("place", "industry_name", "pct_change")
    return F.array_sort(F.collect_list(F.when(F.col("side") == side, card)))


def _themes(cards: str) -> Column:
    return F.transform(F.col(cards), lambda c: theme_of(c["industry_name"]))


def sector_cards(extremes: DataFrame) -> DataFrame:
    gathered = extremes.groupBy("trade_date").agg(_listed("strong").alias("strong_"), _listed("weak").alias("weak_"))
    spread = F.get("strong_", F.lit(0))["pct_change"] - F.get("weak_", F.lit(0))["pct_change"]
    both = F.concat("strong_", "weak_")
    falling = F.size(F.filter(both, lambda c: c["pct_change"] < 0))
    return gathered.select(
        "trade_date",
        F.col("strong_.industry_name").alias("strongest_sectors"),
        F.col("weak_.industry_name").alias("weakest_sectors"),
        _themes("strong_").alias("strong_themes"), _themes("weak_").alias("weak_themes"),
        spread.alias("sector_spread"), (falling / F.size(both)).alias("sector_down_ratio"),
    )


def sector_summary(sectors: DataFrame, cards: DataFrame) -> DataFrame:
    up = F.avg((F.coalesce("pct_change", F.lit(0.0)) > 0).cast("double"))
    breadth = sectors.groupBy("trade_date").agg(up.alias("up_ratio"))
    code = (
        F.when(F.col("up_ratio") >= BROAD_UP, "mostly_up").when(F.col("up_ratio") <= BROAD_DOWN, "mostly_down")
        .when(F.col("sector_spread") >= DIVERGENCE, "divergent").otherwise("balanced")
    )
    return breadth.join(cards, "trade_date").select("trade_date", "up_ratio", code.alias("sector_summary"))


def structural_risks(metrics: DataFrame, cards: DataFrame, warned: DataFrame | None = None) -> DataFrame:
    """Risk codes per date in fixed order, at most the first three."""
    card = F.struct("return_1d", "position", "symbol")
    weakest = F.slice(F.array_sort(F.collect_list(card)), 1, 2)["symbol"]
    indexes = metrics.groupBy("trade_date").agg(
        weakest.alias("two_weakest_"), F.avg((F.col("return_1d") < 0).cast("double")).alias("index_down_ratio")
    )
    joined = indexes.join(cards, "trade_date", "full_outer")
    if warned is not None:
        joined = warned.select("trade_date", "has_warnings").join(joined, "trade_date", "left")
    else:
        joined = joined.withColumn("has_warnings", F.lit(False))
    empty = F.array().cast("array<string>")
    two, themes = F.coalesce("two_weakest_", empty), F.coalesce("weak_themes", empty)
    first_theme = F.get(themes, F.lit(0))
    zero = F.lit(0.0)
    flags = [
        ("data_insufficient", F.col("has_warnings")),
        ("general_weakness", (F.coalesce("index_down_ratio", zero) >= INDEX_DOWN)
         & (F.coalesce("sector_down_ratio", zero) >= SECTOR_DOWN)),
        ("growth_pressure", F.arrays_overlap(two, F.array(*[F.lit(c) for c in fv.GROWTH_INDEXES]))
         | F.array_contains(themes, fv.GROWTH_THEME)),
        ("small_cap_pressure", F.arrays_overlap(two, F.array(*[F.lit(c) for c in fv.SMALL_CAP_INDEXES]))),
        ("sector_divergence", F.coalesce(F.col("sector_spread") >= DIVERGENCE, F.lit(False))),
        ("weak_theme_concentration", F.size(F.filter(themes, lambda t: t == first_theme)) >= 2),
    ]
    raised = F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in flags]))
    return joined.select("trade_date", F.slice(raised, 1, KEPT_RISKS).alias("risks"))


def status(days: DataFrame, metrics: DataFrame, sectors: DataFrame) -> DataFrame:
    """complete, partial or unavailable for each requested date, with its warnings."""
    has_index = metrics.select("trade_date").distinct().withColumn("has_index_", F.lit(True))
    has_sector = sectors.select("trade_date").distinct().withColumn("has_sector_", F.lit(True))
    no_index, no_sector = F.col("has_index_").isNull(), F.col("has_sector_").isNull()
    warnings = F.array_compact(F.array(
        F.when(no_index, F.lit("missing broad index rows")), F.when(no_sector, F.lit("missing sector rows"))
    ))
    code = F.when(no_index & no_sector, "unavailable").when(no_index | no_sector, "partial").otherwise("complete")
    return (
        days.select("trade_date").distinct().join(has_index, "trade_date", "left").join(has_sector, "trade_date", "left")
        .select("trade_date", code.alias("status"), warnings.alias("warnings"))
        .withColumn("has_warnings", F.size("warnings") > 0)
    )


def market_status(days: DataFrame, prices: DataFrame, industry_daily: DataFrame, classification: DataFrame) -> DataFrame:
    """One row per date with everything above.

    Indexes and sectors, a few rows per date, are derived once and written for the steps that share them.
    """
    metrics = materialise(index_metrics(prices), "index-metrics")
    sectors = materialise(sector_metrics(industry_daily, classification), "sector-metrics")
    cards = sector_cards(sector_extremes(sectors))
    states = status(days, metrics, sectors)
    return (
        states.join(strongest_weakest(metrics), "trade_date", "left")
        .join(cards.select("trade_date", "strongest_sectors", "weakest_sectors"), "trade_date", "left")
        .join(sector_summary(sectors, cards), "trade_date", "left")
        .join(structural_risks(metrics, cards, states), "trade_date", "left")
        .drop("has_warnings")
    )
