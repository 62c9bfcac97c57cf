"""Per-security analysis, payload checks, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from .pools import WEAK_RISK_SCORE


def analyse_securities(requested: DataFrame, factors: DataFrame, trade_date=None) -> DataFrame:
    """Analysis row of every requested symbol on one date (default: the newest)."""
    day = F.lit(trade_date).cast("date") if trade_date else factors.agg(F.max("trade_date").alias("d")).scalar()
    rows = factors.filter(F.col("trade_date") == day).withColumn("found_", F.lit(True))
    joined = requested.select("symbol").distinct().join(rows, "symbol", "left")
    found = F.col("found_").isNotNull()
    values = F.array(*[
        F.struct(
            F.lit(code).alias("factor_code"), F.col(code).cast("double").alias("value"),
            F.col(code).isNull().alias("missing_data"),
        )
        for code in fv.ANALYSIS_FACTORS
    ])
    reason = F.col("exclusion_reason")
    notes = F.array_compact(F.array(
        F.when(reason.isNotNull() & (reason != "") & (reason != "none"), reason),
        F.when(F.coalesce("risk_score", F.lit(1.0)) < WEAK_RISK_SCORE, F.lit(fv.WEAK_RISK_NOTE)),
    ))
    return joined.select(
        "symbol", "name", "industry", F.col("market_segment").alias("market"),
        F.coalesce("tradable_flag", F.lit(False)).alias("in_latest_candidate_pool"),
        F.when(found, reason).otherwise(F.lit("not_found_in_factor_run")).alias("exclusion_reason"),
        F.when(found, F.coalesce("total_score", F.lit(0.0))).alias("total_score"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("momentum_score", "flow_score", "risk_score")],
        F.when(found, values).otherwise(F.array().cast("array<struct<factor_code:string,value:double,missing_data:boolean>>")).alias("factor_values"),
        F.when(~found, F.array(F.lit(fv.NO_EVIDENCE_NOTE)))
        .when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(fv.NO_RISK_NOTE))).alias("risk_notes"),
    )


def with_wording_violations(frame: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds every forbidden term in the whole text, in the order of the lists.

    The text is lowered once, in a projection of its own, and each term looked for in that."""
    lowered = F.col("lowered_")
    found = [F.when(F.contains(lowered, F.lit(t)), F.lit(f"prohibited wording: {t}")) for t in fv.PROHIBITED_TERMS]
    found += [F.when(F.contains(lowered, F.lit(t)), F.lit(f"forbidden sensitive field: {t}")) for t in fv.SENSITIVE_TERMS]
    found.append(F.when(lowered.rlike(fv.LOCAL_PATH_PATTERN), F.lit("forbidden local absolute path")))
    terms = frame.withColumn("lowered_", F.lower(text)).withColumn(name, F.array(*found)).drop("lowered_")
    return terms.withColumn(name, F.filter(name, lambda term: term.isNotNull()))


def latest_quotes(watch_list: DataFrame, prices: DataFrame, trade_date=None) -> DataFrame:
    """Newest close and change per watched symbol; symbols without a price are left out."""
    rows = prices if trade_date is None else prices.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    newest = F.max(F.struct("trade_date", "close", "pct_change"))
    watched = rows.join(watch_list.select("symbol").distinct(), "symbol", "left_semi")
    return watched.groupBy("symbol").agg(newest.alias("q_")).select(
        "symbol", F.col("q_.trade_date").alias("quote_date"),
        F.coalesce("q_.close", F.lit(0.0)).alias("last_price"),
        F.coalesce("q_.pct_change", F.lit(0.0)).alias("change_percent"),
    )


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def unpublished(bundles: DataFrame, published: DataFrame) -> DataFrame:
    """Bundles whose (date, hash) was not published before."""
    return bundles.join(published.select("trade_date", "bundle_hash"), ["trade_date", "bundle_hash"], "left_anti")


# The sections a payload must have and the states of a pool's stocks
MARKET_SECTIONS = ["market_status_metadata", "index_markets", "sectors", "structural_risks"]
POOL_SECTIONS = ["candidate_pool_metadata", "strategy", "summary", "top_stocks", "diff"]
BUNDLE_SECTIONS = ["bundle_metadata", "market_status", "candidate_pool"]
CHANGES = ["newly_added", "retained", "upgraded", "downgraded", "removed"]
MARKET_SOURCES = ["tushare.index_daily", "tushare.index_classify", "tushare.sw_daily"]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def numbered_version(prefix: str, day="trade_date") -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.date_format(day, "yyyyMMdd"), F.lit("_001"))


def market_payloads(status: DataFrame) -> DataFrame:
    """(trade_date, market_status) from the rows of market.market_status."""
    card = lambda side: F.struct(
        F.col(side).alias("symbol"), F.col(f"{side}_return").alias("return_1d"), F.col(f"{side}_reason").alias("reason")
    )
    return status.select("trade_date", F.struct(
        F.struct(
            F.lit(fv.MARKET_STATUS_VERSION).alias("schema_version"), "trade_date", "status",
            _texts(MARKET_SOURCES).alias("data_sources"), "warnings",
        ).alias("market_status_metadata"),
        F.struct(card("strongest").alias("strongest"), card("weakest").alias("weakest")).alias("index_markets"),
        F.struct(
            F.col("strongest_sectors").alias("strongest"), F.col("weakest_sectors").alias("weakest"),
            F.col("sector_summary").alias("summary"),
        ).alias("sectors"),
        F.col("risks").alias("structural_risks"),
    ).alias("market_status"))


def candidate_payloads(pools: DataFrame, changes: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """(trade_date, candidate_pool): the stocks of each date, what became of those of the pool before.

    `changes` are rows of compare_pools by date with previous_version_id. A pool has at most
    `top` items, so the gathered arrays are bounded."""
    shown = pools.join(changes.select("trade_date", "symbol", "previous_rank", "change_status"), ["trade_date", "symbol"])
    item = F.struct("rank", "symbol", "theme", "reason_summary", "risk_summary", "change_status", "previous_rank")
    stocks = shown.groupBy("trade_date").agg(F.array_sort(F.collect_list(item)).alias("top_stocks"))
    state = F.col("change_status")
    of = lambda name: F.array_sort(F.collect_list(F.when(state == name, F.col("symbol")))).alias(name)
    diff = changes.groupBy("trade_date").agg(
        F.max("previous_version_id").alias("previous_version_id"), *[of(name) for name in CHANGES]
    )
    compared = F.col("previous_version_id").isNotNull()
    counts = [F.size(name).alias(name) for name in CHANGES]
    return stocks.join(diff, "trade_date").select("trade_date", F.struct(
        F.struct(
            F.lit(fv.CANDIDATE_POOL_VERSION).alias("schema_version"), numbered_version("candidate_pool").alias("version_id"),
            "trade_date", F.lit("candidate_002").alias("source_strategy"), F.lit(fv.FACTOR_VERSION).alias("strategy_version"),
            F.lit(snapshot_id).cast("string").alias("source_snapshot_id"), "previous_version_id",
            F.when(compared, "complete").otherwise("no_previous_version").alias("status"),
        ).alias("candidate_pool_metadata"),
        F.struct(F.lit("candidate_002").alias("strategy_id")).alias("strategy"),
        F.struct(*counts, F.size("top_stocks").alias("total")).alias("summary"),
        "top_stocks",
        F.struct(
            F.when(compared, "compared").otherwise("no_previous_version").alias("status"), "previous_version_id", *CHANGES
        ).alias("diff"),
    ).alias("candidate_pool"))


def daily_bundles(market_status: DataFrame, candidate_pools: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """Both payloads of each date, versioned; `with_bundle_hash` completes them."""
    return market_status.join(candidate_pools, "trade_date").select(
        "trade_date",
        F.struct(
            F.lit(fv.DAILY_BUNDLE_VERSION).alias("schema_version"), numbered_version("daily_bundle").alias("bundle_id"),
            "trade_date", F.lit(snapshot_id).cast("string").alias("source_snapshot_id"),
            F.lit(None).cast("string").alias("bundle_hash"),
            _texts([fv.MARKET_STATUS_VERSION, fv.CANDIDATE_POOL_VERSION]).alias("contains"),
        ).alias("bundle_metadata"),
        "market_status", "candidate_pool",
    )


def bundle_hash() -> Column:
    """SHA-256 of the bundle's JSON without the hash itself."""
    bare = F.col("bundle_metadata").dropFields("bundle_hash").alias("bundle_metadata")
    return F.sha2(F.to_json(F.struct(bare, "market_status", "candidate_pool")), 256)


def with_bundle_hash(bundles: DataFrame) -> DataFrame:
    return bundles.withColumn("bundle_metadata", F.col("bundle_metadata").withField("bundle_hash", bundle_hash()))


def with_bundle_errors(bundles: DataFrame) -> DataFrame:
    """Adds what is wrong with each bundle: absent sections, versions, hash, wording in the whole payload."""
    def missing(names: list[str], owner: str | None = None) -> list[Column]:
        return [F.when(F.col(f"{owner}.{n}" if owner else n).isNull(), F.lit(f"missing section: {n}")) for n in names]

    def version(path: str, wanted: str, name: str) -> Column:
        return F.when(F.coalesce(F.col(path), F.lit("")) != wanted, F.lit(f"unsupported {name} schema_version"))

    known = F.col("bundle_metadata.bundle_hash")
    found = [
        *missing(BUNDLE_SECTIONS), version("bundle_metadata.schema_version", fv.DAILY_BUNDLE_VERSION, "bundle"),
        F.when(known.isNotNull() & (known != bundle_hash()), F.lit("bundle_hash mismatch")),
        *missing(MARKET_SECTIONS, "market_status"),
        version("market_status.market_status_metadata.schema_version", fv.MARKET_STATUS_VERSION, "market_status"),
        *missing(POOL_SECTIONS, "candidate_pool"),
        version("candidate_pool.candidate_pool_metadata.schema_version", fv.CANDIDATE_POOL_VERSION, "candidate_pool"),
    ]
    whole = F.to_json(F.struct(*BUNDLE_SECTIONS))
    checked = with_wording_violations(bundles.withColumn("found_", F.array_compact(F.array(*found))), whole, "wording_")
    return checked.withColumn("errors", F.concat("found_", "wording_")).drop("found_", "wording_")
