"""Making a mapped batch fit its curated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import iso_date, lenient_double
from ..sources.schemas import CuratedTable

# Numeric inputs that may arrive as text
PRICE_NUMBERS = [
    "open", "high", "low", "close", "pre_close", "volume", "amount", "pct_change",
    "turnover_rate", "adj_factor", "limit_up", "limit_down",
]
FLOW_NUMBERS = [
    "main_force_holding_ratio", "close_profit_ratio", "main_net_inflow",
    "main_net_inflow_rate", "retail_net_inflow", "chip_concentration",
]


def add_lineage(frame, table: CuratedTable, source, batch_id, data_version, created_at) -> DataFrame:
    """Stamp the lineage columns a batch does not bring itself, then the date parts.

    batch_id may be a Column, e.g. the Hive partition column of a multi-batch scan.
    """
    stamps = {
        "source": source, "source_batch_id": batch_id,
        "data_version": data_version, "created_at": created_at,
    }
    new = {
        name: (value if not isinstance(value, str) else F.lit(value))
        for name, value in stamps.items()
        if name in table.columns and name not in frame.columns
    }
    if "created_at" in new:
        new["created_at"] = new["created_at"].cast("timestamp")
    return add_date_parts(frame.withColumns(new) if new else frame, table)


def add_date_parts(frame: DataFrame, table: CuratedTable) -> DataFrame:
    day = table.date_column
    if day is None or day not in frame.columns:
        return frame
    prefix = day.split("_")[0]
    parts = {f"{prefix}_year": F.year, f"{prefix}_month": F.month}
    new = {
        name: part(iso_date(day))
        for name, part in parts.items()
        if name in table.columns and name not in frame.columns
    }
    return frame.withColumns(new) if new else frame


def add_missing_nullable(frame: DataFrame, table: CuratedTable) -> DataFrame:
    absent = [c for c in table.nullable if c not in frame.columns]
    return frame.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in absent}) if absent else frame


def null_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (column, null_count) from a single pass over the data."""
    wide = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in columns])
    return wide.select(F.inline(entries))


def missing_required(frame: DataFrame, table: CuratedTable) -> list[str]:
    return [c for c in table.columns if c in table.required and c not in frame.columns]


def validate(frame: DataFrame, table: CuratedTable) -> None:
    """Hard failure on an absent required column or on nulls in one."""
    absent = missing_required(frame, table)
    if absent:
        raise ValueError("missing columns: " + ", ".join(absent))
    required = [c for c in table.columns if c in table.required]
    offending = [r["column"] for r in null_counts(frame, required).filter("null_count > 0").collect()]
    if offending:
        raise ValueError("non-nullable columns contain nulls: " + ", ".join(sorted(offending)))


def conform(frame: DataFrame, table: CuratedTable, keep: list[str] = ()) -> DataFrame:
    """Schema order and types (and the columns to `keep`); text that does not parse becomes null."""
    from pyspark.sql import types as T

    filled = add_missing_nullable(frame, table)

    def typed(field):
        source = filled.schema[field.name].dataType
        if isinstance(field.dataType, T.DateType) and not isinstance(source, T.DateType):
            return iso_date(field.name).alias(field.name)
        if source == field.dataType:
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return filled.select(*[typed(f) for f in table.schema.fields], *keep)


def normalise_prices(frame: DataFrame) -> DataFrame:
    return _normalise(frame, PRICE_NUMBERS, ["trade_date"])


def normalise_flow(frame: DataFrame) -> DataFrame:
    return _normalise(frame, FLOW_NUMBERS, ["trade_date"])


def _normalise(frame, numbers, dates) -> DataFrame:
    kinds = dict(frame.dtypes)
    new = {c: lenient_double(c) for c in numbers if c in kinds and kinds[c] != "double"}
    new |= {c: iso_date(c) for c in dates if c in kinds and kinds[c] != "date"}
    return frame.withColumns(new) if new else frame


def default_factor_inputs(frame: DataFrame) -> DataFrame:
    defaults = {
        "name": F.lit(None).cast("string"),
        "market_segment": F.lit(None).cast("string"),
        "industry": F.lit(None).cast("string"),
        "list_date": F.lit(None).cast("date"),
        "status": F.lit("active"),
        "is_suspended": F.lit(False),
        "limit_up": F.lit(None).cast("double"),
    }
    absent = {c: v for c, v in defaults.items() if c not in frame.columns}
    return frame.withColumns(absent) if absent else frame


def field_catalogue(spark, tables: dict[str, CuratedTable]) -> DataFrame:
    """One row per declared field, with the inferred symbol and time field of its table."""
    # Candidates in order of preference
    symbol_fields = ["symbol"]
    time_fields = ["trade_date", "event_date", "as_of_date", "business_date", "retrieved_at", "created_at"]

    def first(names, columns):
        return next((n for n in names if n in columns), None)

    rows = [
        (
            t.name, position, f.name, f.dataType.simpleString(), f.name not in t.required,
            f.name in t.key, f.name in t.partitions,
            first(symbol_fields, t.columns), first(time_fields, t.columns),
        )
        for t in tables.values()
        for position, f in enumerate(t.schema.fields)
    ]
    return spark.createDataFrame(
        rows,
        "dataset_id string, position int, field_name string, field_type string, nullable boolean, "
        "is_primary_key boolean, is_partition_key boolean, primary_symbol_field string, primary_time_field string",
    )
