"""Curated table definitions: columns, keys, required columns, date partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPE_OF = {
    "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(),
}


@dataclass(frozen=True)
class CuratedTable:
    name: str
    key: tuple[str, ...]
    required: frozenset[str]
    schema: T.StructType
    partitions: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def nullable(self) -> list[str]:
        return [c for c in self.columns if c not in self.required]

    @property
    def date_column(self) -> str | None:
        return next((c for c in ("trade_date", "event_date") if c in self.columns), None)


def _table(name, key, required, columns, partitions=()):
    """Keys, partitions and lineage are always required; the rest may be null unless listed."""
    must = frozenset(key) | frozenset(required) | frozenset(partitions) | frozenset(LINEAGE_COLUMNS)
    declared = ", ".join([columns, *(f"{p} INT" for p in partitions), LINEAGE])  # read without a session
    fields = [field.split() for field in declared.split(",")]
    schema = T.StructType([T.StructField(n, _TYPE_OF[t], n not in must) for n, t in fields])
    return CuratedTable(name, tuple(key), must, schema, tuple(partitions))


# The columns of the curated tables, in their order, with keys, required columns and date parts
LINEAGE = "source STRING, source_batch_id STRING, data_version STRING, created_at TIMESTAMP"
LINEAGE_COLUMNS = ["source", "source_batch_id", "data_version", "created_at"]

SECURITY_MASTER = """
    symbol STRING, raw_symbol STRING, exchange STRING, asset_type STRING, name STRING, market STRING,
    market_segment STRING, market_segment_name STRING, area STRING, industry STRING, list_date DATE,
    delist_date DATE, status STRING
"""
TRADING_CALENDAR = """
    calendar_id STRING, trade_date DATE, is_trading_day BOOLEAN, previous_trade_date DATE, next_trade_date DATE
"""
DAILY_PRICES = """
    symbol STRING, trade_date DATE, asset_type STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE,
    pre_close DOUBLE, volume DOUBLE, amount DOUBLE, pct_change DOUBLE, turnover_rate DOUBLE, adj_factor DOUBLE,
    is_suspended BOOLEAN, limit_up DOUBLE, limit_down DOUBLE
"""
CAPITAL_FLOW_OR_CHIP = """
    symbol STRING, trade_date DATE, main_force_holding_ratio DOUBLE, close_profit_ratio DOUBLE, main_net_inflow DOUBLE,
    main_net_inflow_rate DOUBLE, retail_net_inflow DOUBLE, chip_concentration DOUBLE, data_method STRING
"""
RISK_EVENTS = """
    symbol STRING, event_date DATE, event_type STRING, severity STRING, is_active BOOLEAN, description STRING
"""
INDUSTRY_CLASSIFICATION = """
    index_code STRING, industry_name STRING, level STRING, source_system STRING, parent_code STRING
"""
INDUSTRY_DAILY = """
    index_code STRING, trade_date DATE, industry_name STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE,
    pre_close DOUBLE, pct_change DOUBLE, volume DOUBLE, amount DOUBLE
"""
BY_TRADE_MONTH = ("trade_year", "trade_month")

TABLES: dict[str, CuratedTable] = {
    table.name: table
    for table in [
        _table("security_master", ["symbol"], ["asset_type", "status"], SECURITY_MASTER),
        _table("trading_calendar", ["calendar_id", "trade_date"], ["is_trading_day"], TRADING_CALENDAR),
        _table("daily_prices", ["symbol", "trade_date"], ["asset_type"], DAILY_PRICES, BY_TRADE_MONTH),
        _table("capital_flow_or_chip", ["symbol", "trade_date"], [], CAPITAL_FLOW_OR_CHIP, BY_TRADE_MONTH),
        _table(
            "risk_events", ["symbol", "event_date", "event_type"], ["severity", "is_active"], RISK_EVENTS,
            ("event_year", "event_month"),
        ),
        _table("industry_classification", ["index_code"], ["industry_name", "level", "source_system"], INDUSTRY_CLASSIFICATION),
        _table("industry_daily", ["index_code", "trade_date"], [], INDUSTRY_DAILY, BY_TRADE_MONTH),
    ]
}

# Raw landing dataset -> curated table it feeds.
RAW_TARGET = {
    "security_master": "security_master",
    "trading_calendar": "trading_calendar",
    "daily_prices": "daily_prices",
    "index_daily": "daily_prices",
    "adj_factor": "daily_prices",
    "daily_basic": "daily_prices",
    "stk_limit": "daily_prices",
    "suspend_d": "daily_prices",
    "moneyflow_dc": "capital_flow_or_chip",
    "cyq_perf": "capital_flow_or_chip",
    "index_classify": "industry_classification",
    "sw_daily": "industry_daily",
}

# These only fill columns of price rows that already exist.
SUPPLEMENTAL = ("adj_factor", "daily_basic", "stk_limit")
