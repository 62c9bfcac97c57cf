"""Factor frame: assembly, scores, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import is_st_name, unit_clip
from .enforcement import default_factor_inputs, normalise_flow, normalise_prices
from .indicators import adjust_prices, flow_indicators, price_indicators, stocks_only, with_macd
from .ranking import crowded_days, wide_average_ranks

# Weights of the scores. A minus marks "smaller is better".
SCORE_WEIGHTS = {
    "momentum_score": {"mom_20": 0.35, "mom_60": 0.35, "ma_strength": 0.20},
    "flow_score": {"flow_5d": 0.40, "flow_20d": 0.30, "flow_persistence": 0.30},
    "risk_score": {"-vol_20": 0.40, "max_drawdown_60": 0.40, "-downside_vol_20": 0.20},
    "liquidity_score": {"avg_amount_20": 0.70, "-turnover_stability": 0.30},
}
CROSS_WEIGHT = 0.10
TOTAL_WEIGHTS = {
    "momentum_score": 0.30, "flow_score": 0.25, "chip_score": 0.15, "risk_score": 0.15, "liquidity_score": 0.15,
}
RANKED_INPUTS = [name.lstrip("-") for parts in SCORE_WEIGHTS.values() for name in parts]


def assemble(prices: DataFrame, flow: DataFrame, security: DataFrame, start=None, end=None) -> DataFrame:
    """Indicators over the whole history joined with flow and security attributes.

    asset_type is a property of the symbol, so index rows are dropped before any window.
    Prices, flow and securities are each exchanged once, by symbol; the windows, both
    joins and the exponential average run in that layout. The average comes last
    because rows returned from Python have no known layout. The date range is cut
    after everything that looks back.
    """
    price_rows = price_indicators(adjust_prices(stocks_only(normalise_prices(prices))))
    flow_rows = flow_indicators(normalise_flow(flow))
    attributes = [c for c in ["symbol", "name", "market_segment", "industry", "list_date", "status"] if c in security.columns]
    joined = price_rows.join(flow_rows, ["symbol", "trade_date"], "left").join(
        security.select(*attributes), "symbol", "left"
    )
    unused = {
        "open", "high", "low", "pre_close", "volume", "pct_change", "turnover_rate", "adj_factor", "limit_down",
        "asset_type", "adj_open", "daily_return", "amount",
    }
    rows = with_macd(joined.select(*[c for c in joined.columns if c not in unused]))
    rows = rows.withColumnRenamed("macd_golden_cross", "macd_signal").drop("ema12", "ema26", "dif", "dea", "adj_close")
    if start is not None:
        rows = rows.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return default_factor_inputs(rows)


def rank_score(column: str, inverse: bool = False) -> Column:
    """Average rank over the non-null rows of the date; null scores 0."""
    rank, n = F.col(f"{column}__rank"), F.col(f"{column}__n")
    score = rank / n
    if inverse:
        score = F.lit(1.0) - score + F.lit(1.0) / n
    return F.when(rank.isNotNull(), score).otherwise(F.lit(0.0))


def chip_score(winner_rate="winner_rate") -> Column:
    return F.coalesce(
        F.when(
            F.col(winner_rate).isNotNull(),
            unit_clip(F.lit(1.0) - F.abs(F.col(winner_rate) - F.lit(80.0)) / F.lit(30.0)),
        ),
        F.lit(0.0),
    )


def _weighted(parts: dict[str, float], value) -> Column:
    total = None
    for name, weight in parts.items():
        term = value(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def composite_scores(ranked: DataFrame) -> DataFrame:
    """Scores from the ranks; chip_score is already there, it needs none."""
    def of(name):
        return rank_score(name.lstrip("-"), inverse=name.startswith("-"))

    scores = {target: _weighted(parts, of) for target, parts in SCORE_WEIGHTS.items()}
    crossed = F.coalesce(F.col("macd_signal"), F.lit(False)).cast("double")
    scores["momentum_score"] = scores["momentum_score"] + crossed * F.lit(CROSS_WEIGHT)
    return ranked.withColumns(scores).withColumn("total_score", _weighted(TOTAL_WEIGHTS, F.col))


def exclusion_reason() -> Column:
    """First rule that applies, in this order."""
    age = F.datediff("trade_date", "list_date")
    return (
        F.when(F.coalesce(F.col("status"), F.lit("unknown")) != "active", "inactive_security")
        .when(is_st_name(), "st_security")
        .when(F.coalesce(F.col("is_suspended"), F.lit(False)), "suspended")
        .when(F.col("close") >= F.col("limit_up"), "limit_up")
        .when(age < fv.MIN_LISTING_DAYS, f"listing_age_lt_{fv.MIN_LISTING_DAYS}")
        .when(F.coalesce(F.col("avg_amount_20"), F.lit(0.0)) < fv.MIN_AVG_AMOUNT, "low_liquidity")
        .otherwise("none")
    )


def score(assembled: DataFrame, crowded: list | None = None) -> DataFrame:
    """Ranks use every row of the date, also the ones excluded.

    What does not depend on a rank is settled first, so that fewer columns are exchanged.
    """
    settled = assembled.withColumns({"exclusion_reason": exclusion_reason(), "chip_score": chip_score()})
    wanted = [c for c in settled.columns if c in fv.FACTOR_COLUMNS]
    ranked = wide_average_ranks(settled.select(*wanted), RANKED_INPUTS, crowded=crowded)
    return (
        composite_scores(ranked)
        .withColumn("tradable_flag", F.col("exclusion_reason") == "none")
        .withColumn("factor_version", F.lit(fv.FACTOR_VERSION))
        .select(*fv.FACTOR_COLUMNS)
    )


def daily_factors(prices, flow, security, start=None, end=None, crowded: list | None = None) -> DataFrame:
    """The whole factor run. A date has as many rows as it has stock prices, which are cheap to count."""
    crowded = crowded_days(stocks_only(normalise_prices(prices))) if crowded is None else crowded
    return score(assemble(prices, flow, security, start, end), crowded)
