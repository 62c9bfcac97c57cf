"""Strategy 002 ranking, candidate pools and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from .ranking import top_per_group
from .trades import score_order

# Label thresholds
STRONG_SCORE = 0.7
WEAK_RISK_SCORE = 0.35
MOVED_RANKS = 2


def ranked_tradable(factors: DataFrame, top: int) -> DataFrame:
    """Best tradable rows of every date in `factors`, rank 1 first."""
    if top <= 0:
        raise ValueError("top must be positive")
    tradable = factors.filter(F.coalesce("tradable_flag", F.lit(False)))
    return top_per_group(tradable, ["trade_date"], score_order(), top, "rank")


def latest_factor_date(factors: DataFrame) -> DataFrame:
    """Newest date with a tradable row, else the newest date."""
    tradable = F.coalesce("tradable_flag", F.lit(False))
    return factors.agg(
        F.coalesce(F.max(F.when(tradable, F.col("trade_date"))), F.max("trade_date")).alias("trade_date")
    )


def theme_of(industry: Column) -> Column:
    """Lookup in a fixed map of 26 entries, as a literal map: no join."""
    pairs = [F.lit(v) for entry in fv.INDUSTRY_THEME for v in entry]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(industry, F.lit(""))), F.lit(fv.OTHER_THEME))


def reason_labels() -> Column:
    found = F.array(*[
        F.when(F.coalesce(F.col(score), F.lit(0.0)) >= STRONG_SCORE, F.lit(label)) for score, label in fv.REASON_LABELS
    ])
    text = F.array_join(F.array_compact(found), "、")
    return F.when(text != "", text).otherwise(F.lit(fv.REASON_FALLBACK))


def risk_label() -> Column:
    reason = F.col("exclusion_reason")
    return (
        F.when(reason.isNotNull() & (reason != "") & (reason != "none"), reason)
        .when(F.coalesce("risk_score", F.lit(1.0)) < WEAK_RISK_SCORE, "weak_risk_score")
        .otherwise("none")
    )


def pool_rows(factors: DataFrame, top: int) -> DataFrame:
    return ranked_tradable(factors, top).select(
        "trade_date", "rank", "symbol", "name", F.col("industry").alias("industry_l1"),
        theme_of(F.col("industry")).alias("theme"), reason_labels().alias("reason_summary"),
        risk_label().alias("risk_summary"), F.coalesce("total_score", F.lit(0.0)).alias("total_score"),
    )


def change_status(rank: Column, previous: Column, was_there: Column) -> Column:
    """A symbol that was there without a rank has not moved: it is retained."""
    return (
        F.when(was_there.isNull(), "newly_added")
        .when(previous - rank >= MOVED_RANKS, "upgraded")
        .when(rank - previous >= MOVED_RANKS, "downgraded")
        .otherwise("retained")
    )


def compare_pools(current: DataFrame, previous: DataFrame, key: list[str] = ("symbol",)) -> DataFrame:
    """Every symbol of either pool with its ranks and what became of it."""
    old = previous.select(*key, F.col("rank").alias("previous_rank"), F.lit(True).alias("was_there_"))
    now = current.select(*key, "rank", F.lit(True).alias("is_there_"))
    status = F.when(F.col("is_there_").isNull(), "removed").otherwise(
        change_status(F.col("rank"), F.col("previous_rank"), F.col("was_there_"))
    )
    return now.join(old, list(key), "full_outer").withColumn("change_status", status).drop("was_there_", "is_there_")


def removed_from(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("symbol"), "symbol", "left_anti")


def pool_history(pools: DataFrame, successors: DataFrame) -> DataFrame:
    """All dates at once: each pool against the one of the date before."""
    carried = (
        pools.join(successors.filter(F.col("recommend_trade_date").isNotNull()), "trade_date")
        .select(F.col("recommend_trade_date").alias("trade_date"), "symbol", "rank")
    )
    return compare_pools(pools, carried, ["trade_date", "symbol"])


def with_previous_version(changes: DataFrame, pools: DataFrame, successors: DataFrame) -> DataFrame:
    """The changes of `pool_history` with the version of the pool they refer to."""
    before = pools.select("trade_date").distinct().join(successors, "trade_date").filter("recommend_trade_date IS NOT NULL").select(
        F.col("recommend_trade_date").alias("trade_date"),
        F.concat(F.lit("candidate_pool_"), F.date_format("trade_date", "yyyyMMdd"), F.lit("_001")).alias("previous_version_id"),
    )
    return changes.join(before, "trade_date", "left")


def diff_summary(changes: DataFrame, per: list[str] = ()) -> DataFrame:
    # Change states
    states = ["newly_added", "retained", "upgraded", "downgraded", "removed"]
    return changes.groupBy(*per).agg(
        *[F.count_if(F.col("change_status") == s).alias(s) for s in states],
        F.count_if(F.col("change_status") != "removed").alias("total"),
    )
