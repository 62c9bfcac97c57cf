"""Curated market tables derived from the TPC-H-like test tables.

A supplier is a security, its shipments of one week are one bar, a region is a
broad index and a nation is an industry. Every aggregate is order-free and money
sums are exact decimals, so a bar is the same on any cluster.

Shipments are combined per (supplier, week) before the shuffle, so a supplier
that holds most of lineitem costs one small row per task and week. Index and
industry bars meet the few columns of supplier first and are combined per
(index, week) in the same way: a task sends a row per index and week, not one
per bar.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import growth
from ..operators.raw_mapping import security_columns
from ..plans.runtime import prepare
from .schemas import RAW_TARGET

_EXCHANGES = [".SH", ".SZ", ".BJ"]


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def security_symbol(key: str) -> Column:
    exchange = F.get(_literals(_EXCHANGES), F.pmod(F.col(key), F.lit(3)).cast("int"))
    return F.concat(F.lit("S"), F.col(key).cast("string"), exchange)


def industry_name() -> Column:
    names = _literals([industry for industry, _ in fv.INDUSTRY_THEME])
    return F.coalesce(F.get(names, F.col("n_nationkey")), F.col("n_name"))


def index_symbol() -> Column:
    codes = _literals([code for code, _ in fv.BROAD_INDEXES])
    return F.coalesce(F.get(codes, F.col("r_regionkey")), F.concat(F.lit("IDX_"), F.col("r_name")))


def _hundredths(column: Column) -> Column:
    """Two-decimal amount as an exact whole number of hundredths; whole-number sums
    do not depend on the order in which partial sums meet."""
    return F.rint(column * F.lit(100.0)).cast("bigint")


def _units(name: str) -> Column:
    return F.col(name) / F.lit(100.0)


def _curated_target() -> Column:
    pairs = [F.lit(v) for entry in RAW_TARGET.items() for v in entry]
    return F.create_map(*pairs)[F.col("dataset_name")]


class MarketTables:
    """The curated tables of one scale-factor folder, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def shipments(self) -> DataFrame:
        return self.raw("lineitem").withColumn("trade_date", F.date_trunc("week", "l_shipdate").cast("date"))

    @staticmethod
    def _traded() -> list[Column]:
        """The sums of a bar that stocks, indexes and industries have."""
        price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
        opening = F.col("l_linestatus") == "O"
        return [
            F.sum(_hundredths(price)).alias("amount_"),
            F.sum(_hundredths(quantity)).alias("volume_"),
            F.sum(F.when(opening, _hundredths(price))).alias("open_amount_"),
            F.sum(F.when(opening, _hundredths(quantity))).alias("open_volume_"),
            F.max(price / quantity).alias("high"),
            F.min(price / quantity).alias("low"),
        ]

    @cached_property
    def partial_bars(self) -> DataFrame:
        """(l_suppkey, trade_date) with exact partial sums."""
        price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
        signed = (
            F.when(F.col("l_returnflag") == "N", price)
            .when(F.col("l_returnflag") == "R", -price)
            .otherwise(F.lit(0.0))
        )
        return self.shipments.groupBy("l_suppkey", "trade_date").agg(
            *self._traded(),
            F.sum(_hundredths(signed)).alias("inflow_"),
            F.sum(F.when(F.col("l_discount") >= 0.02, _hundredths(quantity)).otherwise(F.lit(0))).alias("profit_volume_"),
            F.max("l_tax").alias("max_tax_"),
            F.max("l_quantity").alias("max_quantity_"),
        )

    @staticmethod
    def _bar_columns() -> list[Column]:
        return [
            (_units("open_amount_") / _units("open_volume_")).alias("open"),
            F.col("high"),
            F.col("low"),
            (_units("amount_") / _units("volume_")).alias("close"),
            _units("volume_").alias("volume"),
            _units("amount_").alias("amount"),
        ]

    @cached_property
    def stock_bars(self) -> DataFrame:
        tiny = F.col("max_quantity_") < 3
        return self.partial_bars.select(
            security_symbol("l_suppkey").alias("symbol"),
            "trade_date",
            *self._bar_columns(),
            F.when(~tiny, F.lit(1.0) + F.col("max_tax_")).alias("adj_factor"),
            tiny.alias("is_suspended"),
            F.when(F.col("max_tax_") > 0.01, _units("volume_") / F.lit(100.0)).alias("turnover_rate"),
            _units("inflow_").alias("main_net_inflow"),
            (_units("inflow_") / _units("amount_") * F.lit(100.0)).alias("main_net_inflow_rate"),
            (_units("profit_volume_") / _units("volume_") * F.lit(100.0)).alias("close_profit_ratio"),
        )

    def _rolled_up(self, dimension: DataFrame, code: Column, code_name: str) -> DataFrame:
        suppliers = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return (
            self.shipments.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(dimension, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(code.alias(code_name), "trade_date")
            .agg(*self._traded())
            .select(code_name, "trade_date", *self._bar_columns())
        )

    @cached_property
    def geography(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def index_bars(self) -> DataFrame:
        return self._rolled_up(self.geography, index_symbol(), "symbol")

    @staticmethod
    def _with_previous_close(bars: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy("trade_date")
        return bars.withColumn("pre_close", F.lag("close").over(order)).withColumn(
            "pct_change", growth(F.col("close"), F.col("pre_close")) * F.lit(100.0)
        )

    @cached_property
    def prices(self) -> DataFrame:
        """daily_prices: stock and index rows with the previous close beside them.

        Each kind is windowed before the union, so a filter on asset_type drops the
        other branch from the plan.
        """
        stocks = self.stock_bars.drop("main_net_inflow", "main_net_inflow_rate", "close_profit_ratio")
        stocks = self._with_previous_close(stocks, "symbol").withColumns(
            {
                "asset_type": F.lit("stock"),
                "limit_up": F.col("pre_close") * F.lit(1.1),
                "limit_down": F.col("pre_close") * F.lit(0.9),
            }
        )
        indexes = self._with_previous_close(self.index_bars, "symbol").withColumn("asset_type", F.lit("index"))
        return stocks.unionByName(indexes, allowMissingColumns=True)

    @cached_property
    def flow(self) -> DataFrame:
        return self.stock_bars.select(
            "symbol", "trade_date", "main_net_inflow", "main_net_inflow_rate", "close_profit_ratio",
            F.lit(fv.FLOW_METHOD).alias("data_method"),
        )

    @cached_property
    def first_shipment(self) -> DataFrame:
        return self.raw("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").cast("date").alias("list_date"))

    @cached_property
    def raw_security(self) -> DataFrame:
        """Provider-shaped security rows."""
        key = F.col("s_suppkey")
        board = F.get(
            F.when(F.pmod(key, F.lit(2)) == 0, _literals(["主板", "主板", "北交所"]))
            .otherwise(_literals(["科创板", "创业板", "北交所"])),
            F.pmod(key, F.lit(3)).cast("int"),
        )
        st = F.when(F.pmod(key, F.lit(17)) == 0, F.lit("*ST ")).otherwise(F.lit(""))
        return (
            self.raw("supplier")
            .join(self.geography, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.first_shipment, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .select(
                security_symbol("s_suppkey").alias("ts_code"),
                key.cast("string").alias("symbol"),
                F.concat(st, F.col("s_name")).alias("name"),
                F.col("r_name").alias("area"),
                industry_name().alias("industry"),
                board.alias("market"),
                F.date_format("list_date", "yyyyMMdd").alias("list_date"),
                F.lit("").alias("delist_date"),
                "s_acctbal",
            )
        )

    @cached_property
    def security(self) -> DataFrame:
        listed = F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active")
        return self.raw_security.select(*security_columns(), listed.alias("status"))

    @cached_property
    def calendar(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.date_trunc("week", "l_shipdate").cast("date").alias("trade_date")
        ).distinct()

    @cached_property
    def classification(self) -> DataFrame:
        industries = self.raw("nation").select(
            F.concat(F.lit("I"), F.col("n_nationkey").cast("string")).alias("index_code"),
            industry_name().alias("industry_name"),
            F.lit("L1").alias("level"),
            F.lit(fv.CLASSIFICATION_SYSTEM).alias("source_system"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_code"),
        )
        regions = self.raw("region").select(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("index_code"),
            F.col("r_name").alias("industry_name"),
            F.lit("L0").alias("level"),
            F.lit(fv.CLASSIFICATION_SYSTEM).alias("source_system"),
            F.lit(None).cast("string").alias("parent_code"),
        )
        return industries.unionByName(regions)

    @cached_property
    def industry_daily(self) -> DataFrame:
        bars = self._rolled_up(
            self.geography, F.concat(F.lit("I"), F.col("n_nationkey").cast("string")), "index_code"
        )
        return self._with_previous_close(bars, "index_code").withColumn("industry_name", F.lit(None).cast("string"))

    # --- provider-shaped batches ------------------------------------------------

    @cached_property
    def raw_daily(self) -> DataFrame:
        """Overlapping price batches: one per line status, F landed before O.

        `open` is the price of returned lines, so either batch leaves gaps in it.
        """
        price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
        returned = F.col("l_returnflag") == "R"
        return (
            self.raw("lineitem")
            .groupBy("l_linestatus", "l_suppkey", F.date_trunc("week", "l_shipdate").cast("date").alias("week_"))
            .agg(
                F.sum(_hundredths(price)).alias("amount_"),
                F.sum(_hundredths(quantity)).alias("volume_"),
                F.sum(F.when(returned, _hundredths(price))).alias("open_amount_"),
                F.sum(F.when(returned, _hundredths(quantity))).alias("open_volume_"),
                F.max(price / quantity).alias("high"),
                F.min(price / quantity).alias("low"),
            )
            .select(
                F.concat(F.lit("batch_"), "l_linestatus").alias("batch_id"),
                security_symbol("l_suppkey").alias("ts_code"),
                F.date_format("week_", "yyyyMMdd").alias("trade_date"),
                *self._bar_columns()[:4],
                F.lit(None).cast("double").alias("pre_close"),
                _units("volume_").alias("vol"),
                _units("amount_").alias("amount"),
                F.lit(None).cast("double").alias("pct_chg"),
            )
        )

    def _raw_per_bar(self, *columns: Column) -> DataFrame:
        return self.partial_bars.select(
            security_symbol("l_suppkey").alias("ts_code"),
            F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
            *columns,
        )

    @cached_property
    def raw_adj_factor(self) -> DataFrame:
        """Factors as text; a zero tax reads 'n/a'."""
        text = (F.lit(1.0) + F.col("max_tax_")).cast("string")
        return self._raw_per_bar(F.when(F.col("max_tax_") > 0, text).otherwise("n/a").alias("adj_factor"))

    @cached_property
    def raw_daily_basic(self) -> DataFrame:
        return self._raw_per_bar((_units("volume_") / F.lit(100.0)).cast("string").alias("turnover_rate"))

    @cached_property
    def raw_limits(self) -> DataFrame:
        return self._raw_per_bar(
            (F.col("high") * F.lit(1.1)).alias("up_limit"), (F.col("low") * F.lit(0.9)).alias("down_limit")
        )

    @cached_property
    def raw_suspensions(self) -> DataFrame:
        return self._raw_per_bar(F.when(F.col("max_quantity_") < 3, "S").otherwise("R").alias("suspend_type"))

    @cached_property
    def raw_money_flow(self) -> DataFrame:
        return self._raw_per_bar(
            _units("inflow_").alias("net_amount"),
            (_units("inflow_") / _units("amount_") * F.lit(100.0)).alias("net_amount_rate"),
        )

    @cached_property
    def raw_chips(self) -> DataFrame:
        held = F.col("profit_volume_") > 0
        return self._raw_per_bar(
            F.when(held, _units("profit_volume_") / _units("volume_") * F.lit(100.0)).alias("winner_rate"),
            F.when(held, "found").otherwise("not_found").alias("provider_status"),
        )

    @cached_property
    def raw_calendar(self) -> DataFrame:
        """Every order date; Mondays are open."""
        day = F.col("day_")
        monday = F.date_trunc("week", day).cast("date")
        return (
            self.raw("orders").select(F.col("o_orderdate").cast("date").alias("day_")).distinct()
            .select(
                F.lit("SSE").alias("exchange"),
                F.date_format(day, "yyyyMMdd").alias("cal_date"),
                F.when(day == monday, "1").otherwise("0").alias("is_open"),
                F.when(day == monday, F.date_format(F.date_sub(monday, 7), "yyyyMMdd")).otherwise("").alias("pretrade_date"),
            )
        )

    @cached_property
    def raw_classification(self) -> DataFrame:
        return self.classification.filter(F.col("level") == "L1").drop("source_system")

    @cached_property
    def raw_industry_bars(self) -> DataFrame:
        names = self.classification.select("index_code", F.col("industry_name").alias("name"))
        return self.industry_daily.drop("industry_name").join(names, "index_code").select(
            F.col("index_code").alias("ts_code"), "name", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
            "close", F.col("pct_change").alias("pct_chg"), F.col("volume").alias("vol"), "amount",
        )

    @cached_property
    def raw_index_bars(self) -> DataFrame:
        return self.index_bars.select(
            F.col("symbol").alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
            "open", "high", "low", "close",
        )

    # --- run and version records --------------------------------------------------

    @cached_property
    def batches(self) -> DataFrame:
        """An order is a landed batch, its lines are the batch's rows."""
        datasets = _literals(list(RAW_TARGET))
        lines = self.raw("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("row_count"))
        return (
            self.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.concat(F.lit("batch_"), F.col("o_orderkey").cast("string")).alias("batch_id"),
                F.col("o_orderpriority").alias("source"),
                F.get(datasets, F.pmod("o_custkey", F.lit(len(RAW_TARGET))).cast("int")).alias("dataset_name"),
                F.col("o_orderdate").cast("date").alias("retrieved_at"),
                F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed")
                .otherwise("running").alias("status"),
                F.coalesce("row_count", F.lit(0)).alias("row_count"),
                F.concat(F.col("o_orderpriority"), F.lit("-"), F.col("o_totalprice").cast("string")).alias("schema_hash"),
                F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("customer"),
            )
        )

    @cached_property
    def version_batches(self) -> DataFrame:
        """A curated version per dataset and day holds that day's batches."""
        return self.batches.select(
            "batch_id", "retrieved_at", "row_count", _curated_target().alias("dataset_id"),
        ).withColumn(
            "curated_version_id", F.concat_ws("_", "dataset_id", F.date_format("retrieved_at", "yyyyMMdd"))
        )

    @cached_property
    def versions(self) -> DataFrame:
        version = F.col("curated_version_id")
        earlier = Window.partitionBy("dataset_id").orderBy("created_at", "curated_version_id")
        return self.version_batches.groupBy("curated_version_id", "dataset_id", F.col("retrieved_at").alias("created_at")).agg(
            F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("batch_count")
        ).withColumns(
            {
                "schema_version_id": F.concat("dataset_id", F.lit("_v001")),
                "path": F.concat(F.lit("/curated/"), version), "checksum": F.sha2(version, 256),
                "as_of_date": F.col("created_at").cast("string"),
                # the table is imported anew at the start of a month
                "predecessor_id": F.when(
                    F.date_trunc("month", F.lag("created_at").over(earlier)) == F.date_trunc("month", "created_at"), F.lag(version).over(earlier)),
            }
        )

    @cached_property
    def snapshot_versions(self) -> DataFrame:
        """A snapshot per month refers to the versions made in it."""
        return self.versions.select(
            F.concat(F.lit("snapshot_"), F.date_format("created_at", "yyyyMM"), F.lit("01_001")).alias("snapshot_id"),
            "curated_version_id",
        )
