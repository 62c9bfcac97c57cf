"""Provider-shaped batches -> curated columns.

Each raw dataset is one projection. A column the provider left out becomes a
typed null, so batches of different vintages line up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import compact_date, lenient_double


def exchange_of(code="ts_code") -> Column:
    return F.get(F.split(F.col(code), r"\."), F.lit(1))


def _segment(position: int, fallback: str) -> Column:
    """position 2 = segment code, 3 = display name."""
    exchange, board = exchange_of(), F.col("market")
    beijing = fv.BEIJING_SEGMENT
    named = [
        F.when((exchange == row[0]) & (board == row[1]), F.lit(row[position])) for row in fv.MARKET_SEGMENTS
    ]
    named.append(F.when((exchange == beijing[0]) | (board == beijing[1]), F.lit(beijing[position])))
    return F.coalesce(*named, F.lit(fallback))


def market_segment() -> Column:
    return _segment(2, fv.UNKNOWN_SEGMENT[0])


def market_segment_name() -> Column:
    return _segment(3, fv.UNKNOWN_SEGMENT[1])


def _key_columns() -> list[Column]:
    return [F.col("ts_code").alias("symbol"), compact_date("trade_date").alias("trade_date")]


def _present(frame: DataFrame, names, target: str, dtype="double") -> Column:
    """First of `names` the batch carries, else null."""
    for name in names:
        if name in frame.columns:
            return F.col(name).try_cast(dtype).alias(target)
    return F.lit(None).cast(dtype).alias(target)


def _numbers(frame, names) -> list[Column]:
    return [_present(frame, [n], n) for n in names]


def security_columns() -> list:
    """security_master columns but the status."""
    return [
        F.col("ts_code").alias("symbol"),
        F.col("symbol").cast("string").alias("raw_symbol"),
        exchange_of().alias("exchange"),
        F.lit("stock").alias("asset_type"),
        F.col("name"),
        F.col("market"),
        market_segment().alias("market_segment"),
        market_segment_name().alias("market_segment_name"),
        F.col("area"),
        F.col("industry"),
        compact_date("list_date").alias("list_date"),
        compact_date("delist_date").alias("delist_date"),
    ]


def _security_master(frame):
    return [*security_columns(), F.lit("active").alias("status")]


def _trading_calendar(frame):
    return [
        F.lit(fv.CALENDAR_ID).alias("calendar_id"),
        compact_date("cal_date").alias("trade_date"),
        (F.col("is_open").try_cast("bigint") == 1).alias("is_trading_day"),
        compact_date("pretrade_date").alias("previous_trade_date"),
        F.lit(None).cast("date").alias("next_trade_date"),
    ]


def _bars(frame, asset_type):
    return [
        *_key_columns(),
        F.lit(asset_type).alias("asset_type"),
        *_numbers(frame, ["open", "high", "low", "close", "pre_close"]),
        _present(frame, ["vol"], "volume"),
        _present(frame, ["amount"], "amount"),
        _present(frame, ["pct_chg"], "pct_change"),
    ]


def _price_columns(renames: dict[str, str]):
    def project(frame):
        return [*_key_columns(), *[lenient_double(raw).alias(name) for raw, name in renames.items()]]

    return project


def _suspensions(frame):
    return [*_key_columns(), (F.col("suspend_type") == "S").alias("is_suspended")]


def suspension_events(frame: DataFrame, keep: list[str] = ()) -> DataFrame:
    """suspend_d seen as risk events."""
    halted = F.col("suspend_type") == "S"
    return frame.select(
        F.col("ts_code").alias("symbol"),
        compact_date("trade_date").alias("event_date"),
        F.lit("suspension").alias("event_type"),
        F.when(halted, "blocker").otherwise("info").alias("severity"),
        halted.alias("is_active"),
        F.concat(F.lit("Tushare suspend_d suspend_type="), F.col("suspend_type")).alias("description"),
        *keep,
    )


def _money_flow(frame):
    return [
        *_key_columns(),
        lenient_double("net_amount").alias("main_net_inflow"),
        lenient_double("net_amount_rate").alias("main_net_inflow_rate"),
        F.lit(fv.FLOW_METHOD).alias("data_method"),
    ]


def _chips(frame):
    method = F.lit(fv.CHIP_METHOD)
    if "provider_status" in frame.columns:
        method = F.when(
            F.col("provider_status") == "not_found", F.lit(f"{fv.CHIP_METHOD}:not_found")
        ).otherwise(method)
    return [
        *_key_columns(), lenient_double("winner_rate").alias("close_profit_ratio"), method.alias("data_method")
    ]


def _classification(frame):
    system = F.col("src") if "src" in frame.columns else F.lit(fv.CLASSIFICATION_SYSTEM)
    return [
        "index_code", "industry_name", "level", system.alias("source_system"),
        _present(frame, ["parent_code"], "parent_code", "string"),
    ]


def _industry_bars(frame):
    return [
        F.col("ts_code").alias("index_code"),
        compact_date("trade_date").alias("trade_date"),
        _present(frame, ["name"], "industry_name", "string"),
        *_numbers(frame, ["open", "high", "low", "close", "pre_close"]),
        _present(frame, ["pct_change", "pct_chg"], "pct_change"),
        _present(frame, ["vol"], "volume"),
        _present(frame, ["amount"], "amount"),
    ]


_PROJECTIONS = {
    "security_master": _security_master,
    "trading_calendar": _trading_calendar,
    "daily_prices": lambda frame: _bars(frame, "stock"),
    "index_daily": lambda frame: _bars(frame, "index"),
    "adj_factor": _price_columns({"adj_factor": "adj_factor"}),
    "daily_basic": _price_columns({"turnover_rate": "turnover_rate"}),
    "stk_limit": _price_columns({"up_limit": "limit_up", "down_limit": "limit_down"}),
    "suspend_d": _suspensions,
    "moneyflow_dc": _money_flow,
    "cyq_perf": _chips,
    "index_classify": _classification,
    "sw_daily": _industry_bars,
}


def map_raw(frame: DataFrame, dataset: str, keep: list[str] = ()) -> DataFrame:
    """One projection; `keep` carries landing columns such as the batch id along."""
    if dataset not in _PROJECTIONS:
        raise ValueError(f"unsupported raw dataset mapping: {dataset}")
    return frame.select(*_PROJECTIONS[dataset](frame), *keep)


def missing_expected_fields(frame: DataFrame, api: str) -> list[str]:
    """Contract check of a batch header; no data is read."""
    return sorted(set(fv.EXPECTED_FIELDS[api]) - set(frame.columns))
