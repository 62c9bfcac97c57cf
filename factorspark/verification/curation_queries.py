"""Landing, mapping, enforcement, merging, quality, catalogue, coverage (A to G) and the stream (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import compact_date, short_hash
from ..operators import catalog, coverage, date_masks, enforcement, merging, quality
from ..operators.raw_mapping import map_raw, missing_expected_fields, suspension_events
from ..plans import promotion, symbol_files as symbol_file_plans
from ..plans.runtime import materialise, new_path
from ..sources import curated_tables, raw_batches
from ..sources.schemas import RAW_TARGET, TABLES
from ..sources.weekly_bars import MarketTables
from . import curation_sql  # noqa: F401  (adds SQL parts)
from . import sql
from .registry import near, registered
from .sql import near_all, text

KEY = ["symbol", "trade_date"]
BAR = ["open", "high", "low", "close", "volume", "amount"]
RAW_COLUMNS = ["ts_code", "trade_date", "open", "high", "low", "close", "pre_close", "vol", "amount", "pct_chg"]
DAY, STAMP = "2002-01-01", "2002-01-01 00:00:00"


def bars_sql(table: str, extra: str = "") -> str:
    return f"SELECT {extra}ts_code AS symbol, trade_date, {near_all(BAR, 4)} FROM {table}"


# --- A ------------------------------------------------------------------------

def landed(m: MarketTables) -> str:
    """Both price batches written as partitioned CSV; returns the root."""
    root = new_path(m.spark, "raw")
    raw_batches.write_batches(
        m.raw_daily.withColumns(
            {"source": F.lit("lines"), "dataset": F.lit("daily_prices"), "as_of_date": F.lit(DAY)}
        ),
        root,
    )
    return root


@registered("a01_raw_csv_scan", bars_sql("batchf", "batch_id, "))
def _(m):
    rows = raw_batches.read_batches(m.spark, landed(m), RAW_COLUMNS, dataset="daily_prices", batch_id="batch_F")
    mapped = map_raw(rows, "daily_prices", ["batch_id"])
    return near(mapped.select("batch_id", *KEY, *BAR), BAR, 4)


_PREFIX = "lines_daily_prices_20020101"


def _landed_batches(m, ws):
    return [
        promotion.land_batch(ws, "lines", "daily_prices", m.raw_daily.filter(F.col("batch_id") == b).select(*RAW_COLUMNS), DAY)
        for b in ("batch_F", "batch_O")
    ]


def _record_run(ws, run_id, tasks):
    """Tasks of a run: (dataset, trade date, offset, status, batch id)."""
    rows = [(run_id, f"task_{i}", *task) for i, task in enumerate(tasks)]
    promotion.record_tasks(ws, ws.spark.createDataFrame(rows, promotion.TASK_SCHEMA))


@registered("a11_multi_batch_scan", f"""
SELECT CASE batch_id WHEN 'batch_F' THEN '{_PREFIX}_001' ELSE '{_PREFIX}_002' END AS batch_id, CASE batch_id WHEN 'batch_F' THEN 1 ELSE 0 END AS position,
  ts_code AS symbol, trade_date, {near_all(BAR, 4)} FROM rawdaily""")
def _(m):
    """The successful batches of a run, in the order of its tasks."""
    ws = workspace(m)
    first, second = _landed_batches(m, ws)
    _record_run(ws, "run_1", [
        ("daily_prices", "20020102", None, "success", first), ("daily_prices", "20020101", 5, "success", second),
        ("daily_prices", "20020103", None, "failed", None), ("daily_prices", "20020104", None, "failed", first),
    ])
    _record_run(ws, "run_2", [("daily_prices", "20020101", None, "success", first)])
    frames = raw_batches.read_recorded(m.spark, ws.raw_root, promotion.run_batches(ws, "run_1"))
    mapped = map_raw(raw_batches.stack_batches(frames), "daily_prices", ["batch_id", "position"])
    return near(mapped.select("batch_id", "position", *KEY, *BAR), BAR, 4)


@registered("a09_raw_batch_sink", f"""
SELECT CASE batch_id WHEN 'batch_F' THEN '{_PREFIX}_001' ELSE '{_PREFIX}_002' END AS batch_id, {text('lines')} AS source, {text('daily_prices')} AS dataset_name,
  {text(DAY)} AS business_date, count(*) AS row_count, {text('csv')} AS format, {text('success')} AS status, sha256({text(','.join(RAW_COLUMNS))}) AS schema_hash
FROM rawdaily GROUP BY 1, batch_id""")
def _(m):
    ws = workspace(m)
    _landed_batches(m, ws)
    return ws.metadata("data_batches").select(
        "batch_id", "source", "dataset_name", "business_date", "row_count", "format", "status", "schema_hash"
    )


def workspace(m: MarketTables) -> promotion.Workspace:
    return promotion.Workspace(m.spark, new_path(m.spark, "workspace"))


def current_prices(m: MarketTables) -> DataFrame:
    """Merged price batches with lineage, in the curated schema."""
    frames = [
        map_raw(m.raw_daily.filter(F.col("batch_id") == b), "daily_prices", ["batch_id"]) for b in ("batch_F", "batch_O")
    ]
    first, second = [f.withColumnRenamed("batch_id", "source_batch_id") for f in frames]
    merged = merging.coalescing_merge(first, second, KEY)
    table = TABLES["daily_prices"]
    return enforcement.conform(
        enforcement.add_lineage(merged, table, "lines", "", DAY, STAMP), table
    )


@registered("a02_csv_import", f"""
SELECT symbol, trade_date, year(trade_date)::INTEGER AS trade_year, month(trade_date)::INTEGER AS trade_month, {text('manual_csv')} AS source, {near_all(BAR, 4)} FROM merged""")
def _(m):
    ws = workspace(m)
    path = new_path(m.spark, "manual")
    current_prices(m).select(*KEY, "asset_type", *BAR).write.option("header", True).csv(path)
    rows = promotion.import_csv(ws, "daily_prices", path, as_of_date=DAY)
    return near(rows.select(*KEY, "trade_year", "trade_month", "source", *BAR), BAR, 4)


def stored_prices(m: MarketTables) -> tuple[str, DataFrame]:
    root = new_path(m.spark, "store")
    return root, curated_tables.overwrite_table(current_prices(m), root, "daily_prices")


@registered("a03_curated_scan", f"SELECT symbol, trade_date, {near_all(['close', 'amount'], 4)} FROM merged")
def _(m):
    _, rows = stored_prices(m)
    return near(rows.select(*KEY, "close", "amount"), ["close", "amount"], 4)


@registered("a04_count_only_scan", "SELECT count(*) AS row_count FROM merged")
def _(m):
    root, _ = stored_prices(m)
    return curated_tables.count_only(m.spark, curated_tables.table_path(root, "daily_prices"))


@registered("a05_head_scan", f"SELECT symbol, trade_date, {near_all(['close'], 4)} FROM merged ORDER BY trade_date DESC, symbol LIMIT 5")
def _(m):
    _, rows = stored_prices(m)
    head = rows.select(*KEY, "close").orderBy(F.col("trade_date").desc(), "symbol").limit(5)
    return near(head, ["close"], 4)


_IMPORTED = "SELECT count(*) FROM merged"


@registered("a06_snapshot_scan", f"SELECT symbol, trade_date, {near_all(BAR, 4)}, ({_IMPORTED}) AS recorded_rows, true AS matches FROM merged")
def _(m):
    """A snapshot after two more promotions, the first of which changes every close: its rows, count and checksum are the old ones."""
    ws = workspace(m)
    _import(ws, m)
    snapshot_id = promotion.create_snapshot(ws, DAY)
    changed = m.raw_daily.filter(F.col("batch_id") == "batch_F").withColumn("close", F.col("close").cast("double") + 1).select(*RAW_COLUMNS)
    for rows in (changed, m.raw_daily.filter(F.col("batch_id") == "batch_O").select(*RAW_COLUMNS)):
        batch = promotion.land_batch(ws, "lines", "daily_prices", rows, DAY)
        promotion.promote_batch(ws, "lines", "daily_prices", batch_id=batch)
    entry = curated_tables.snapshot_entries(ws.metadata("snapshot_manifests"), snapshot_id, ["daily_prices"])["daily_prices"]
    rows = curated_tables.read_snapshot(m.spark, ws.root, snapshot_id, ["daily_prices"])["daily_prices"]
    shaped = enforcement.conform(rows, TABLES["daily_prices"])
    matches = curated_tables.fingerprint(shaped, "daily_prices") == (entry["row_count"], int(entry["checksum"]))
    shown = rows.select(*KEY, *BAR, F.lit(entry["row_count"]).alias("recorded_rows"), F.lit(matches).alias("matches"))
    return near(shown, BAR, 4)


def _import(ws, m):
    path = new_path(m.spark, "manual")
    current_prices(m).select(*KEY, "asset_type", *BAR).write.option("header", True).csv(path)
    return promotion.import_csv(ws, "daily_prices", path, as_of_date=DAY)


@registered("a08_curated_sink", """
SELECT 'daily_prices' AS dataset_id, count(*) AS row_count, count(DISTINCT (year(trade_date), month(trade_date))) AS partition_count FROM merged""")
def _(m):
    _, rows = stored_prices(m)
    return rows.agg(
        F.lit("daily_prices").alias("dataset_id"), F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("trade_year", "trade_month").alias("partition_count"),
    )


# --- B ------------------------------------------------------------------------

@registered("b01_security_master", """
SELECT symbol, raw_symbol, exchange, asset_type, name, market, area, industry, list_date, delist_date, 'active' AS status FROM security""")
def _(m):
    return map_raw(m.raw_security, "security_master").drop("market_segment", "market_segment_name")


@registered("b02_trading_calendar", f"""
SELECT {text(fv.CALENDAR_ID)} AS calendar_id, day AS trade_date, is_open AS is_trading_day, CASE WHEN is_open THEN day - 7 END AS previous_trade_date,
  CAST(NULL AS DATE) AS next_trade_date FROM rawcalendar""")
def _(m):
    return map_raw(m.raw_calendar, "trading_calendar")


@registered("b03_daily_prices", bars_sql("rawdaily", "batch_id, 'stock' AS asset_type, CAST(NULL AS DOUBLE) AS pre_close, CAST(NULL AS DOUBLE) AS pct_change, "))
def _(m):
    return near(map_raw(m.raw_daily, "daily_prices", ["batch_id"]), BAR, 4)


@registered("b04_index_daily", f"""
SELECT symbol, trade_date, 'index' AS asset_type, {near_all(['open', 'high', 'low', 'close'], 4)}, CAST(NULL AS DOUBLE) AS pre_close,
  CAST(NULL AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS pct_change FROM indexbars""")
def _(m):
    return near(map_raw(m.raw_index_bars, "index_daily"), ["open", "high", "low", "close"], 4)


@registered("b05_adj_factor", "SELECT symbol, trade_date, CASE WHEN max_tax > 0 THEN floor((1 + max_tax) * 1e6 + 0.5001) / 1e6 END AS adj_factor FROM maxima")
def _(m):
    return near(map_raw(m.raw_adj_factor, "adj_factor"), ["adj_factor"])


@registered("b06_daily_basic", f"SELECT symbol, trade_date, {sql.near('volume / 100')} AS turnover_rate FROM stockbars")
def _(m):
    return near(map_raw(m.raw_daily_basic, "daily_basic"), ["turnover_rate"])


@registered("b07_price_limits", f"SELECT symbol, trade_date, {sql.near('high * 1.1::DOUBLE', 4)} AS limit_up, {sql.near('low * 0.9::DOUBLE', 4)} AS limit_down FROM stockbars")
def _(m):
    return near(map_raw(m.raw_limits, "stk_limit"), ["limit_up", "limit_down"], 4)


@registered("b08_suspensions", "SELECT symbol, trade_date, max_quantity < 3 AS is_suspended FROM maxima")
def _(m):
    return map_raw(m.raw_suspensions, "suspend_d")


@registered("b09_suspension_events", """
SELECT symbol, trade_date AS event_date, 'suspension' AS event_type, CASE WHEN max_quantity < 3 THEN 'blocker' ELSE 'info' END AS severity,
  max_quantity < 3 AS is_active, concat('Tushare suspend_d suspend_type=', CASE WHEN max_quantity < 3 THEN 'S' ELSE 'R' END) AS description FROM maxima""")
def _(m):
    return suspension_events(m.raw_suspensions)


@registered("b10_money_flow", f"SELECT symbol, trade_date, {near_all(['main_net_inflow', 'main_net_inflow_rate'], 4)}, data_method FROM flow")
def _(m):
    return near(map_raw(m.raw_money_flow, "moneyflow_dc"), ["main_net_inflow", "main_net_inflow_rate"], 4)


@registered("b11_chip_distribution", f"""
SELECT symbol, trade_date, CASE WHEN close_profit_ratio > 0 THEN {sql.near('close_profit_ratio')} END AS close_profit_ratio,
  CASE WHEN close_profit_ratio > 0 THEN {text(fv.CHIP_METHOD)} ELSE {text(fv.CHIP_METHOD + ':not_found')} END AS data_method FROM flow""")
def _(m):
    return near(map_raw(m.raw_chips, "cyq_perf"), ["close_profit_ratio"])


@registered("b12_classification", "SELECT index_code, industry_name, level, source_system, parent_code FROM classification WHERE level = 'L1'")
def _(m):
    return map_raw(m.raw_classification, "index_classify")


@registered("b13_industry_bars", f"""
SELECT d.index_code, d.trade_date, c.industry_name, {sql.near('d.close', 4)} AS close, {sql.near('d.pct_change')} AS pct_change,
  {sql.near('d.volume', 2)} AS volume, {sql.near('d.amount', 2)} AS amount
FROM industrydaily d JOIN classification c ON d.index_code = c.index_code""")
def _(m):
    rows = map_raw(m.raw_industry_bars, "sw_daily").drop("open", "high", "low", "pre_close")
    return near(near(near(rows, ["close"], 4), ["pct_change"]), ["volume", "amount"], 2)


@registered("b14_market_segment", "SELECT symbol, market_segment, market_segment_name FROM security")
def _(m):
    return map_raw(m.raw_security, "security_master").select("symbol", "market_segment", "market_segment_name")


@registered("b15_lenient_dates", """
SELECT doc_id, n_chars, CASE WHEN length(CAST(n AS VARCHAR)) = 8 THEN CAST(try_strptime(CAST(n AS VARCHAR), '%Y%m%d') AS DATE) END AS parsed
FROM (SELECT doc_id, n_chars, 19990100 + (n_chars % 1400) AS n FROM documents)""")
def _(m):
    code = (F.lit(19990100) + F.pmod("n_chars", F.lit(1400))).cast("string")
    return m.raw("documents").select("doc_id", "n_chars", compact_date(code).alias("parsed"))


# --- C ------------------------------------------------------------------------

def mapped_f(m):
    return map_raw(m.raw_daily.filter(F.col("batch_id") == "batch_F"), "daily_prices")


@registered("c1_lineage_columns", f"""
SELECT ts_code AS symbol, trade_date, 'lines' AS source, batch_id AS source_batch_id, {text(DAY)} AS data_version, year(trade_date)::INTEGER AS trade_year FROM rawdaily""")
def _(m):
    mapped = map_raw(m.raw_daily, "daily_prices", ["batch_id"])
    rows = enforcement.add_lineage(mapped, TABLES["daily_prices"], "lines", F.col("batch_id"), DAY, STAMP)
    return rows.select(*KEY, "source", "source_batch_id", "data_version", "trade_year")


@registered("c2_date_parts", "SELECT symbol, trade_date AS event_date, year(trade_date)::INTEGER AS event_year, month(trade_date)::INTEGER AS event_month FROM maxima")
def _(m):
    rows = enforcement.add_date_parts(suspension_events(m.raw_suspensions), TABLES["risk_events"])
    return rows.select("symbol", "event_date", "event_year", "event_month")


@registered("c3_missing_nullable", f"SELECT symbol, trade_date, CAST(NULL AS DOUBLE) AS chip_concentration, CAST(NULL AS DOUBLE) AS retail_net_inflow, {near_all(['main_net_inflow'], 4)} FROM flow")
def _(m):
    rows = enforcement.add_missing_nullable(map_raw(m.raw_money_flow, "moneyflow_dc"), TABLES["capital_flow_or_chip"])
    return near(rows.select(*KEY, "chip_concentration", "retail_net_inflow", "main_net_inflow"), ["main_net_inflow"], 4)


def damaged_prices(m) -> DataFrame:
    """Line-level rows taken as prices: repeated keys, and gaps in required columns."""
    from ..sources.weekly_bars import security_symbol

    return m.raw("lineitem").select(
        security_symbol("l_suppkey").alias("symbol"),
        F.when(F.col("l_quantity") > 1, F.date_trunc("week", "l_shipdate").cast("date")).alias("trade_date"),
        F.when(F.col("l_returnflag") != "A", "stock").alias("asset_type"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        F.col("l_linestatus").alias("line_status"),
    )


_DAMAGED = f"""(SELECT {sql._symbol('l_suppkey')} AS symbol, CASE WHEN l_quantity > 1 THEN week END AS trade_date,
  CASE WHEN l_returnflag <> 'A' THEN 'stock' END AS asset_type FROM weeks)"""


@registered("c4_required_nulls", f"""
SELECT 'symbol' AS "column", count(*) - count(symbol) AS null_count FROM {_DAMAGED} UNION ALL
SELECT 'trade_date', count(*) - count(trade_date) FROM {_DAMAGED} UNION ALL SELECT 'asset_type', count(*) - count(asset_type) FROM {_DAMAGED}""")
def _(m):
    return enforcement.null_counts(damaged_prices(m), ["symbol", "trade_date", "asset_type"])


@registered("c5_lenient_numbers", f"""
SELECT symbol, trade_date, {near_all(['close'], 4)}, CASE WHEN max_tax > 0 THEN floor((1 + max_tax) * 1e6 + 0.5001) / 1e6 END AS adj_factor
FROM stockbars JOIN maxima USING (symbol, trade_date)""")
def _(m):
    text_rows = m.raw_adj_factor.select(
        F.col("ts_code").alias("symbol"), compact_date("trade_date").cast("string").alias("trade_date"), "adj_factor"
    )
    closes = m.stock_bars.select("symbol", F.col("trade_date").cast("string").alias("trade_date"), F.col("close").cast("string").alias("close"))
    rows = enforcement.normalise_prices(closes.join(text_rows, KEY))
    return near(near(rows, ["close"], 4), ["adj_factor"])


@registered("c6_default_inputs", """
SELECT symbol, trade_date, 'active' AS status, FALSE AS is_suspended, CAST(NULL AS DOUBLE) AS limit_up, CAST(NULL AS DATE) AS list_date FROM flow""")
def _(m):
    rows = enforcement.default_factor_inputs(m.flow.select(*KEY))
    return rows.select(*KEY, "status", "is_suspended", "limit_up", "list_date")


_BATCH_APIS = {
    "stock_basic": "raw_security", "trade_cal": "raw_calendar", "daily": "raw_daily", "adj_factor": "raw_adj_factor",
    "index_daily": "raw_index_bars", "daily_basic": "raw_daily_basic", "stk_limit": "raw_limits",
    "suspend_d": "raw_suspensions", "moneyflow_dc": "raw_money_flow", "cyq_perf": "raw_chips",
    "index_classify": "raw_classification", "sw_daily": "raw_industry_bars",
}


# --- D ------------------------------------------------------------------------

def _two_batches(m):
    first, second = [
        map_raw(m.raw_daily.filter(F.col("batch_id") == b), "daily_prices", ["batch_id"])
        .withColumnRenamed("batch_id", "source_batch_id") for b in ("batch_F", "batch_O")
    ]
    return first, second


@registered("d1_coalescing_merge", f"SELECT symbol, trade_date, source_batch_id, {near_all(BAR, 4)} FROM merged")
def _(m):
    rows = merging.coalescing_merge(*_two_batches(m), KEY)
    return near(rows.select(*KEY, "source_batch_id", *BAR), BAR, 4)


@registered("d2_known_keys_only", """
SELECT m.symbol, m.trade_date, CASE WHEN max_tax > 0 THEN floor((1 + max_tax) * 1e6 + 0.5001) / 1e6 END AS adj_factor
FROM maxima m WHERE EXISTS (SELECT 1 FROM batchf f WHERE f.ts_code = m.symbol AND f.trade_date = m.trade_date)""")
def _(m):
    rows = merging.only_known_keys(map_raw(m.raw_adj_factor, "adj_factor"), mapped_f(m), KEY)
    return near(rows, ["adj_factor"])


@registered("d3_overlap_summary", """
SELECT count(*) AS incoming_rows, 0 AS incoming_duplicate_keys,
  count(*) FILTER (WHERE (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM batchf)) AS overlap_keys FROM batcho""")
def _(m):
    first, second = _two_batches(m)
    return merging.overlap_summary(first, second, KEY)


@registered("d4_duplicate_keys", "SELECT count(*) AS duplicate_keys FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(m):
    return merging.duplicate_key_count(m.raw("lineitem"), ["l_orderkey", "l_linenumber"])


_STORED = near_all([*BAR], 4)


@registered("d5_promote_batch", f"""
SELECT symbol, trade_date, 'lines_adj_factor_20020101_001' AS source_batch_id, {_STORED},
  CASE WHEN max_tax > 0 THEN floor((1 + max_tax) * 1e6 + 0.5001) / 1e6 END AS adj_factor
FROM merged JOIN maxima USING (symbol, trade_date)""")
def _(m):
    """Two price batches, then a supplemental factor batch, each landed and promoted."""
    ws = workspace(m)
    _landed_batches(m, ws)
    for number in ("001", "002"):
        promotion.promote_batch(ws, "lines", "daily_prices", batch_id=f"{_PREFIX}_{number}")
    promotion.land_batch(ws, "lines", "adj_factor", m.raw_adj_factor, DAY)
    promotion.promote_batch(ws, "lines", "adj_factor")
    rows = ws.current("daily_prices").select(*KEY, "source_batch_id", *BAR, "adj_factor")
    return near(near(rows, BAR, 4), ["adj_factor"])


@registered("d6_promote_run", f"""
SELECT symbol, trade_date, 'lines_suspend_d_20020101_001' AS source_batch_id, max_quantity < 3 AS is_suspended, {_STORED} FROM merged JOIN maxima USING (symbol, trade_date)""")
def _(m):
    """A run over two datasets: two price batches, then suspensions of the rows they made."""
    ws = workspace(m)
    first, second = _landed_batches(m, ws)
    halts = promotion.land_batch(ws, "lines", "suspend_d", m.raw_suspensions, DAY)
    _record_run(ws, "run_1", [
        ("daily_prices", "20020101", 0, "success", first), ("daily_prices", "20020101", 1000, "success", second),
        ("suspend_d", "20020101", None, "success", halts), ("suspend_d", "20020102", None, "failed", None),
    ])
    promotion.promote_run(ws, "run_1")
    return near(ws.current("daily_prices").select(*KEY, "source_batch_id", "is_suspended", *BAR), BAR, 4)


@registered("d7_dual_target", """
SELECT 'risk_events' AS target, symbol, trade_date AS day, max_quantity < 3 AS halted FROM maxima
UNION ALL SELECT 'daily_prices', ts_code, f.trade_date, max_quantity < 3 FROM batchf f JOIN maxima x ON x.symbol = f.ts_code AND x.trade_date = f.trade_date""")
def _(m):
    ws = workspace(m)
    promotion.land_batch(ws, "lines", "daily_prices", m.raw_daily.filter(F.col("batch_id") == "batch_F").select(*RAW_COLUMNS), DAY)
    promotion.promote_batch(ws, "lines", "daily_prices")
    promotion.land_batch(ws, "lines", "suspend_d", m.raw_suspensions, DAY)
    promotion.promote_batch(ws, "lines", "suspend_d")
    events = ws.current("risk_events").select(
        F.lit("risk_events").alias("target"), "symbol", F.col("event_date").alias("day"), F.col("is_active").alias("halted")
    )
    prices = ws.current("daily_prices").select(
        F.lit("daily_prices").alias("target"), "symbol", F.col("trade_date").alias("day"), F.col("is_suspended").alias("halted")
    )
    return events.unionByName(prices)


@registered("d8_merged_batch_ids", """
SELECT customer, dataset_name, CASE WHEN first_success IS NOT NULL THEN 0 ELSE 1 END AS side, coalesce(first_success, first_other) AS position
FROM (SELECT customer, dataset_name, min(k) FILTER (WHERE status = 'success') AS first_success, min(k) FILTER (WHERE status <> 'success') AS first_other
  FROM (SELECT *, CAST(substr(batch_id, 7) AS BIGINT) AS k FROM batches) GROUP BY 1, 2)""")
def _(m):
    rows = m.batches.withColumn("position", F.regexp_extract("batch_id", "_([0-9]+)$", 1).cast("bigint"))
    edges = rows.select("customer", "dataset_name", "position", "status")
    existing, incoming = edges.filter("status = 'success'").drop("status"), edges.filter("status <> 'success'").drop("status")
    return merging.merged_batch_edges(existing, incoming, "customer", "dataset_name", "position")


@registered("d9_latest_batch", """
SELECT source, dataset_name, batch_id, retrieved_at FROM (SELECT *, row_number() OVER (PARTITION BY source, dataset_name ORDER BY retrieved_at DESC, batch_id DESC) AS n
  FROM batches WHERE status = 'success') WHERE n = 1""")
def _(m):
    return merging.latest_successful(m.batches, ["source", "dataset_name"])


@registered("d10_version_status", "SELECT curated_version_id, dataset_id, status FROM activeversions")
def _(m):
    return merging.with_version_status(m.versions).select("curated_version_id", "dataset_id", "status")


# --- E ------------------------------------------------------------------------

def _targets(m):
    """Requested: all raw dataset names; catalogue: the curated tables that have versions."""
    requested = m.batches.select(F.col("dataset_name").alias("dataset_id")).distinct()
    known = m.versions.select("dataset_id").distinct()
    schemas = m.versions.groupBy("dataset_id").agg(F.max("schema_version_id").alias("schema_version_id")).filter(
        F.col("dataset_id") != "trading_calendar"
    )
    current = merging.with_version_status(m.versions).filter("status = 'active'").filter(F.col("dataset_id") != "security_master")
    return quality.resolve_targets(requested, known, schemas, current)


_TARGETS_SQL = """(SELECT r.dataset_id, k.dataset_id IS NOT NULL AS registered, CASE WHEN k.dataset_id <> 'trading_calendar' THEN concat(k.dataset_id, '_v001') END AS schema_version_id,
  v.curated_version_id, v.row_count FROM (SELECT DISTINCT dataset_name AS dataset_id FROM batches) r
  LEFT JOIN (SELECT DISTINCT dataset_id FROM versions) k ON k.dataset_id = r.dataset_id
  LEFT JOIN activeversions v ON v.dataset_id = r.dataset_id AND v.status = 'active' AND v.dataset_id <> 'security_master')"""


@registered("e1_target_resolution", f"SELECT dataset_id, registered, schema_version_id, curated_version_id, row_count::DOUBLE AS row_count FROM {_TARGETS_SQL}")
def _(m):
    return _targets(m).drop("path").withColumn("row_count", F.col("row_count").cast("double"))


@registered("e2_catalogue_issues", f"""
SELECT dataset_id, 'not_registered' AS check_name FROM {_TARGETS_SQL} WHERE NOT registered
UNION ALL SELECT dataset_id, 'schema_missing' FROM {_TARGETS_SQL} WHERE registered AND schema_version_id IS NULL
UNION ALL SELECT dataset_id, 'current_version_missing' FROM {_TARGETS_SQL} WHERE registered AND curated_version_id IS NULL""")
def _(m):
    return quality.catalogue_issues(_targets(m)).select("dataset_id", "check_name")


@registered("e3_empty_table", """
SELECT 'daily_prices' AS dataset_id, 'empty' AS check_name, 0 AS detail WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity < 0)""")
def _(m):
    """Rows with a negative quantity: the table is read in full and none is there."""
    rows = m.raw("lineitem").filter(F.col("l_quantity") < 0)
    return quality.row_count_issues(rows, "daily_prices", None).select("dataset_id", "check_name", "detail")


@registered("e4_row_count_mismatch", """
SELECT 'daily_prices' AS dataset_id, 'row_count_mismatch' AS check_name, (SELECT count(*) FROM merged) - (SELECT count(*) FROM batchf) AS detail""")
def _(m):
    recorded = mapped_f(m).count()
    return quality.row_count_issues(current_prices(m), "daily_prices", recorded).select("dataset_id", "check_name", "detail")


_ABSENT = [c for c in TABLES["daily_prices"].columns if c not in ("symbol", "trade_date", "asset_type", "close")]


@registered("e6_null_issues", f"""
SELECT * FROM (SELECT 'trade_date' AS column_name, count(*) - count(trade_date) AS detail FROM {_DAMAGED}
UNION ALL SELECT 'asset_type', count(*) - count(asset_type) FROM {_DAMAGED}) WHERE detail > 0""")
def _(m):
    return quality.null_issues(damaged_prices(m), TABLES["daily_prices"], "daily_prices").select("column_name", "detail")


@registered("e7_duplicate_keys", f"""
SELECT 'daily_prices' AS dataset_id, 'duplicate_primary_keys' AS check_name, count(*) AS detail
FROM (SELECT 1 FROM {_DAMAGED} GROUP BY symbol, trade_date HAVING count(*) > 1)""")
def _(m):
    return quality.duplicate_issues(damaged_prices(m), TABLES["daily_prices"], "daily_prices").select("dataset_id", "check_name", "detail")


def _notes(m):
    """Promotion notes made from each day's batches: failed ones count as overlap, running ones as duplicates."""
    per_version = m.batches.groupBy("dataset_name").agg(
        F.count_if(F.col("status") == "failed").alias("overlap_keys"),
        F.count_if(F.col("row_count") == 0).alias("incoming_duplicate_keys"),
        F.max("batch_id").alias("last_promoted_batch_id"),
    )
    overlap = F.struct("overlap_keys", "incoming_duplicate_keys").alias("last_promote_overlap")
    return per_version.select(
        F.col("dataset_name").alias("dataset_id"), F.to_json(F.struct("last_promoted_batch_id", overlap)).alias("notes")
    )


@registered("e8_promotion_warnings", """
SELECT dataset_name AS dataset_id, k AS check_name, last_batch AS column_name, v AS detail, 'warning' AS severity FROM (
  SELECT dataset_name, max(batch_id) AS last_batch, count(*) FILTER (WHERE status = 'failed') AS overlap, count(*) FILTER (WHERE row_count = 0) AS dup FROM batches GROUP BY 1),
  LATERAL (VALUES ('overlapping_keys', overlap), ('incoming_duplicate_keys', dup)) t(k, v) WHERE v > 0""")
def _(m):
    return quality.promotion_warnings(_notes(m))


@registered("e9_quality_report", f"""
SELECT 'daily_prices' AS dataset_id, n AS issue_count, 0 AS warning_count, n = 0 AS passed FROM (
  SELECT {len(_ABSENT) + 1} + (SELECT CAST(count(*) > count(trade_date) AS INTEGER) + CAST(count(*) > count(asset_type) AS INTEGER) + CAST(count(*) = 0 AS INTEGER) FROM {_DAMAGED})
    + (SELECT CAST(count(*) > 0 AS INTEGER) FROM (SELECT 1 FROM {_DAMAGED} GROUP BY symbol, trade_date HAVING count(*) > 1)) AS n)""")
def _(m):
    rows = damaged_prices(m)
    issues = quality.table_issues(rows, TABLES["daily_prices"])
    listed = rows.agg(F.lit("daily_prices").alias("dataset_id"))
    return quality.report(issues, listed)


# --- F ------------------------------------------------------------------------

@registered("f1_snapshot_totals", "SELECT count(*) AS dataset_count, sum(row_count)::BIGINT AS total_row_count FROM activeversions WHERE status = 'active'")
def _(m):
    return catalog.snapshot_manifest(merging.with_version_status(m.versions)).select("dataset_count", "total_row_count")


@registered("f2_next_number", """
SELECT concat('snapshot_', strftime(retrieved_at, '%Y%m%d')) AS prefix, concat('snapshot_', strftime(retrieved_at, '%Y%m%d'), '_', CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS next_id
FROM (SELECT retrieved_at, max(CAST(substr(batch_id, 7) AS BIGINT)) + 1 AS n FROM batches GROUP BY 1)""")
def _(m):
    ids = m.batches.select(
        F.concat(F.lit("snapshot_"), F.date_format("retrieved_at", "yyyyMMdd")).alias("prefix"), "batch_id"
    )
    numbered = catalog.next_number(ids, "batch_id", ["prefix"])
    return numbered.select("prefix", catalog.numbered_id(F.col("prefix"), F.col("next_number")).alias("next_id"))


@registered("f3_inspect_snapshot", """
SELECT dataset_id, curated_version_id, concat(dataset_id, '_v001') AS schema_version_id, row_count, strftime(created_at, '%Y-%m-%d') AS as_of_date FROM activeversions WHERE status = 'active'""")
def _(m):
    manifest = catalog.snapshot_manifest(merging.with_version_status(m.versions)).select("manifest_json")
    return catalog.inspect_snapshot(manifest).drop("path", "checksum")


@registered("f4_list_runs", """
SELECT batch_id, source, dataset_name, retrieved_at, status, row_count, (SELECT count(*) FROM batches) AS total_runs FROM batches ORDER BY retrieved_at DESC, batch_id DESC LIMIT 20""")
def _(m):
    return catalog.list_runs(m.batches.drop("customer"), 20).drop("schema_hash")


@registered("f5_run_lineage", """
SELECT batch_id, contains.version AS curated_version_id, snapshot_id FROM versionbatches b JOIN (
  WITH RECURSIVE grown(ancestor, version) AS (
    SELECT curated_version_id, curated_version_id FROM versions
    UNION ALL SELECT ancestor, v.curated_version_id FROM grown JOIN versions v ON v.predecessor_id = grown.version)
  SELECT * FROM grown) contains ON contains.ancestor = b.curated_version_id
LEFT JOIN snapshotversions s ON s.curated_version_id = contains.version""")
def _(m):
    return catalog.run_lineage(m.batches, m.version_batches, m.versions, m.snapshot_versions)


@registered("f6_inspect_version", """
SELECT curated_version_id, row_count, (SELECT count(*) FROM merged) AS actual_row_count, 16 + 6 AS column_count, row_count = (SELECT count(*) FROM merged) AS matches
FROM activeversions WHERE dataset_id = 'daily_prices' AND status = 'active'""")
def _(m):
    version = merging.with_version_status(m.versions).filter("dataset_id = 'daily_prices' and status = 'active'")
    return catalog.inspect_version(version.select("curated_version_id", "row_count"), current_prices(m))


@registered("f7_preview", f"""
SELECT symbol, name, market_segment_name, area, industry, trade_date, {near_all(['pct_change'], 4)}, {near_all(['close'], 4)}
FROM prices LEFT JOIN security USING (symbol) WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' ORDER BY trade_date DESC, symbol LIMIT 20""")
def _(m):
    rows = catalog.preview(m.prices, "daily_prices", m.security, start="1999-01-01", end="1999-06-30")
    return near(rows, ["pct_change", "close"], 4)


@registered("f7_rows_of_symbols", f"""
SELECT symbol, trade_date, {near_all(BAR, 4)} FROM merged
WHERE symbol IN (SELECT min(symbol) FROM merged UNION ALL SELECT max(symbol) FROM merged)""")
def _(m):
    """Two promoted batches, entries taken after the first: of two symbols the rows of the files that can hold them."""
    ws = workspace(m)
    _landed_batches(m, ws)
    promotion.promote_batch(ws, "lines", "daily_prices", batch_id=f"{_PREFIX}_001")
    symbol_file_plans.record(ws, "daily_prices")
    promotion.promote_batch(ws, "lines", "daily_prices", batch_id=f"{_PREFIX}_002")
    symbol_file_plans.record(ws, "daily_prices")
    ends = ws.current("daily_prices").agg(F.min("symbol").alias("first"), F.max("symbol").alias("last")).first()
    return near(symbol_file_plans.rows_of(ws, "daily_prices", [ends["first"], ends["last"]]).select(*KEY, *BAR), BAR, 4)


@registered("f8_short_hash", """
SELECT batch_id, CASE WHEN length(h) > 16 THEN substr(h, 1, 12) || '...' ELSE h END AS shown FROM (SELECT batch_id, concat(source, ' of ', customer) AS h FROM batches)""")
def _(m):
    return m.batches.select("batch_id", short_hash(F.concat("source", F.lit(" of "), "customer")).alias("shown"))


@registered("f9_latest_snapshot", """
SELECT snapshot_id, created_at FROM (SELECT concat('snapshot_', strftime(created_at, '%Y%m%d')) AS snapshot_id, created_at FROM versions) ORDER BY created_at DESC, snapshot_id DESC LIMIT 1""")
def _(m):
    rows = m.versions.select(
        F.concat(F.lit("snapshot_"), F.date_format("created_at", "yyyyMMdd")).alias("snapshot_id"), "created_at"
    )
    return catalog.latest_snapshot(rows)


@registered("f10_latest_factor_run", f"""
SELECT batch_id AS factor_run_id, strftime(retrieved_at, '%Y-%m-%d') AS newest FROM batches WHERE source LIKE '%HIGH%' OR source LIKE '%URGENT%' ORDER BY retrieved_at DESC, batch_id DESC LIMIT 1""")
def _(m):
    family = F.when(F.contains("source", F.lit("HIGH")), F.lit(fv.FACTOR_VERSION)).when(
        F.contains("source", F.lit("URGENT")), F.lit("candidate_002_v2")
    ).otherwise(F.lit("other_v1"))
    runs = m.batches.select(
        F.col("batch_id").alias("factor_run_id"), family.alias("factor_version"), F.col("retrieved_at").alias("end_date"),
        F.lit(None).cast("string").alias("created_at"),
    )
    return catalog.latest_factor_run(runs)


# --- G ------------------------------------------------------------------------

@registered("g1_provider_open_dates", "SELECT day AS trade_date FROM rawcalendar WHERE is_open")
def _(m):
    return coverage.provider_open_dates(m.raw_calendar)


@registered("g2_local_open_dates", "SELECT day AS trade_date FROM rawcalendar WHERE is_open")
def _(m):
    return coverage.local_open_dates(map_raw(m.raw_calendar, "trading_calendar"))


def _all_days(m):
    return coverage.calendar_union(coverage.provider_open_dates(m.raw_calendar), m.calendar)


_ALL_DAYS = "(SELECT day AS trade_date FROM rawcalendar WHERE is_open UNION SELECT trade_date FROM calendar)"


@registered("g3_calendar_union", f"SELECT trade_date FROM {_ALL_DAYS}")
def _(m):
    return _all_days(m)


@registered("g4_date_successors", "SELECT trade_date, recommend_trade_date FROM successors")
def _(m):
    from ..operators.signals import date_successors

    return date_successors(m.calendar)


_COVERED = f"""(SELECT 'daily_prices' AS dataset, trade_date FROM prices WHERE asset_type = 'stock'
UNION SELECT 'adj_factor', trade_date FROM prices WHERE asset_type = 'stock' AND adj_factor IS NOT NULL
UNION SELECT 'daily_basic', trade_date FROM prices WHERE asset_type = 'stock' AND turnover_rate IS NOT NULL
UNION SELECT 'stk_limit', trade_date FROM prices WHERE asset_type = 'stock' AND limit_up IS NOT NULL
UNION SELECT 'suspend_d', trade_date FROM prices WHERE asset_type = 'stock' AND is_suspended IS NOT NULL
UNION SELECT 'moneyflow_dc', trade_date FROM flow WHERE main_net_inflow IS NOT NULL
UNION SELECT 'sw_daily', trade_date FROM industrydaily)"""


def _covered(m):
    return (
        coverage.price_coverage(m.prices).unionByName(coverage.flow_coverage(m.flow))
        .unionByName(coverage.generic_coverage(m.industry_daily, "sw_daily"))
    )


@registered("g5_covered_dates", f"SELECT dataset, trade_date FROM {_COVERED}")
def _(m):
    return _covered(m)


@registered("g6_benchmark_coverage", """
SELECT 'index_daily' AS dataset, trade_date FROM prices WHERE symbol IN ('000852.SH', '000300.SH', '000905.SH') AND NOT (symbol = '000905.SH' AND day(trade_date) <= 10) GROUP BY trade_date HAVING count(DISTINCT symbol) = 3""")
def _(m):
    """On some days one of the three benchmarks has no row."""
    held = ~((F.col("symbol") == "000905.SH") & (F.dayofmonth("trade_date") <= 10))
    return coverage.benchmark_coverage(m.prices.filter(held), ["000852.SH", "000300.SH", "000905.SH"])


_WANTED = ["daily_prices", "adj_factor", "stk_limit", "cyq_perf", "sw_daily"]


@registered("g7_missing_dates", f"""
SELECT d.dataset, c.trade_date FROM {_ALL_DAYS} c JOIN (VALUES {', '.join(f'({text(d)})' for d in _WANTED)}) d(dataset) ON TRUE
WHERE c.trade_date >= DATE '1995-01-01' AND c.trade_date <= DATE '1999-12-31' AND (d.dataset, c.trade_date) NOT IN (SELECT (dataset, trade_date) FROM {_COVERED})""")
def _(m):
    return coverage.missing_dates(_all_days(m), _WANTED, _covered(m), "1995-01-01", "1999-12-31")


_HELD = """(SELECT 'daily_prices' AS dataset, symbol, trade_date FROM prices WHERE asset_type = 'stock'
UNION SELECT 'adj_factor', symbol, trade_date FROM prices WHERE asset_type = 'stock' AND adj_factor IS NOT NULL
UNION SELECT 'daily_basic', symbol, trade_date FROM prices WHERE asset_type = 'stock' AND turnover_rate IS NOT NULL
UNION SELECT 'stk_limit', symbol, trade_date FROM prices WHERE asset_type = 'stock' AND limit_up IS NOT NULL
UNION SELECT 'suspend_d', symbol, trade_date FROM prices WHERE asset_type = 'stock' AND is_suspended IS NOT NULL
UNION SELECT 'moneyflow_dc', symbol, trade_date FROM flow WHERE main_net_inflow IS NOT NULL)"""


def _held_masks(m):
    """Masks of three overlapping parts of the prices and of the flow, combined."""
    year = F.year("trade_date")
    parts = [m.prices.filter(year <= 1995), m.prices.filter(year.between(1994, 1996)), m.prices.filter(year > 1996)]
    return date_masks.combined(*map(date_masks.price_masks, parts), date_masks.flow_masks(m.flow))


@registered("g5_covered_by_masks", f"SELECT DISTINCT dataset, trade_date FROM {_HELD}")
def _(m):
    return date_masks.covered_dates(_held_masks(m))


@registered("g7_missing_by_symbol", f"""
SELECT d.dataset, s.symbol, c.trade_date FROM (SELECT DISTINCT symbol FROM security WHERE status = 'active') s, (SELECT trade_date FROM {_ALL_DAYS}) c,
  (VALUES ('daily_prices'), ('stk_limit'), ('moneyflow_dc')) d(dataset) WHERE c.trade_date >= DATE '1995-01-01' AND NOT EXISTS
  (SELECT 1 FROM {_HELD} h WHERE h.dataset = d.dataset AND h.symbol = s.symbol AND h.trade_date = c.trade_date)""")
def _(m):
    wanted = ["daily_prices", "stk_limit", "moneyflow_dc"]
    return date_masks.missing_by_symbol(_all_days(m), wanted, coverage.active_symbols(m.security), _held_masks(m), "1995-01-01")


@registered("g8_sync_start", f"""
SELECT coalesce((SELECT min(trade_date) FROM {_ALL_DAYS} WHERE trade_date > b.behind), (SELECT max(trade_date) FROM {_ALL_DAYS})) AS start_date
FROM (SELECT min(last) AS behind FROM (SELECT dataset, max(trade_date) AS last FROM (SELECT * FROM {_COVERED} UNION ALL SELECT 'orders', day FROM rawcalendar WHERE is_open) GROUP BY 1)) b""")
def _(m):
    orders = coverage.generic_coverage(coverage.provider_open_dates(m.raw_calendar), "orders")
    return coverage.sync_start(_all_days(m), _covered(m).unionByName(orders))


@registered("g9_fetch_start", "SELECT least(CAST(max(trade_date) + 1 AS DATE), DATE '2001-12-31' - 45) AS fetch_start FROM calendar")
def _(m):
    return coverage.calendar_fetch_start(m.calendar, "2001-12-31", 45)


@registered("g10_active_symbols", "SELECT DISTINCT symbol FROM security WHERE status = 'active'")
def _(m):
    return coverage.active_symbols(m.security)


@registered("g11_work_list", """
SELECT 'daily_prices' AS dataset, trade_date, CAST(NULL AS DOUBLE) AS symbol_start, CAST(NULL AS DOUBLE) AS symbol_end FROM calendar
UNION ALL SELECT 'moneyflow_dc', trade_date, s::DOUBLE, least(s + 40, n)::DOUBLE FROM calendar, (SELECT count(DISTINCT symbol) AS n FROM security WHERE status = 'active'),
  LATERAL (SELECT unnest(range(0, n, 40)) AS s)""")
def _(m):
    requests = coverage.work_list(["daily_prices", "moneyflow_dc"], m.calendar, coverage.active_symbols(m.security), 40)
    return requests.withColumns({c: F.col(c).cast("double") for c in ("symbol_start", "symbol_end")})


@registered("g11_span_work_list", """
SELECT 'cyq_perf' AS dataset, DATE '2001-01-01' AS start_date, DATE '2001-06-30' AS end_date, s AS symbol_start, least(s + 7, n) AS symbol_end
FROM (SELECT count(DISTINCT symbol) AS n FROM security WHERE status = 'active'), LATERAL (SELECT unnest(range(0, n, 7)) AS s)""")
def _(m):
    return coverage.span_work_list("cyq_perf", "2001-01-01", "2001-06-30", coverage.active_symbols(m.security), 7)


@registered("g12_span_not_found", f"""
SELECT s.symbol AS ts_code, coalesce(strftime(f.trade_date, '%Y%m%d'), '20010630') AS trade_date, {sql.near('f.close_profit_ratio')} AS winner_rate,
  CASE WHEN f.symbol IS NULL THEN '20010101' END AS request_start_date, CASE WHEN f.symbol IS NULL THEN '20010630' END AS request_end_date,
  CASE WHEN f.symbol IS NULL THEN 'not_found' ELSE 'found' END AS provider_status, CASE WHEN f.symbol IS NULL THEN 'empty_result' END AS provider_message
FROM (SELECT DISTINCT symbol FROM security) s LEFT JOIN (SELECT * FROM flow WHERE trade_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'
  AND close_profit_ratio > 0 AND ascii(right(symbol, 4)) % 2 = 0) f ON f.symbol = s.symbol""")
def _(m):
    """Symbols without a chip row in the span asked for; those of an odd last digit have none at all."""
    span = F.col("trade_date").between(F.lit("2001-01-01").cast("date"), F.lit("2001-06-30").cast("date"))
    digit = F.ascii(F.right("symbol", F.lit(4))) % 2 == 0
    results = m.flow.filter(span & (F.col("close_profit_ratio") > 0) & digit).select(
        F.col("symbol").alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.col("close_profit_ratio").alias("winner_rate"))
    requested = m.security.select(F.col("symbol").alias("ts_code"))
    return near(coverage.span_not_found(requested, results, "2001-01-01", "2001-06-30"), ["winner_rate"])


@registered("g12_not_found_rows", f"""
SELECT symbol, trade_date, {sql.near('winner_rate')} AS winner_rate, CASE WHEN winner_rate IS NULL THEN 'not_found' ELSE 'found' END AS provider_status,
  CASE WHEN winner_rate IS NULL THEN 'empty_result' END AS provider_message
FROM (SELECT symbol, trade_date, nullif(close_profit_ratio, 0) AS winner_rate FROM flow)""")
def _(m):
    requested = m.flow.select("symbol", "trade_date")
    results = m.flow.filter(F.col("close_profit_ratio") > 0).select("symbol", "trade_date", F.col("close_profit_ratio").alias("winner_rate"))
    return near(coverage.with_not_found(results, requested, KEY), ["winner_rate"])


@registered("g13_run_statistics", """
SELECT dataset_name, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status <> 'success') AS remaining, sum(row_count)::BIGINT AS rows FROM batches GROUP BY 1""")
def _(m):
    return coverage.run_statistics(m.batches, ["dataset_name"])


@registered("g14_error_classes", f"""
SELECT conv_id, turn, CASE WHEN limited THEN 'rate_limit' WHEN denied THEN 'permission_denied' ELSE 'unknown' END AS reason, limited AS retryable
FROM (SELECT conv_id, turn, {' OR '.join(f'contains(lower(text), {text(w)})' for w in fv.RATE_LIMIT_WORDS)} AS limited,
  {' OR '.join(f'contains(lower(text), {text(w)})' for w in fv.PERMISSION_WORDS)} AS denied
  FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'No permission: ' || text ELSE text END AS text FROM conversations))""")
def _(m):
    """Every second turn speaks of permissions; some of these mention rates too."""
    reason, retryable = coverage.classify_error("text")
    rows = m.raw("conversations").withColumn(
        "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("No permission: "), "text")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", reason.alias("reason"), retryable.alias("retryable"))


# --- S ------------------------------------------------------------------------

def _streamed(m, per_trigger):
    """Both batches through the stream, the later one landed first; a second run finds nothing new."""
    from ..streaming.incremental import promote_stream

    ws = workspace(m)
    for batch in ("batch_O", "batch_F"):
        promotion.land_batch(ws, "lines", "daily_prices", m.raw_daily.filter(F.col("batch_id") == batch).select(*RAW_COLUMNS), DAY)
    for _run in range(2):
        promote_stream(ws, "daily_prices", f"{ws.root}/stream-checkpoint", STAMP, per_trigger).awaitTermination()
    return ws


_LATER = f"coalesce(f.{{0}}, o.{{0}})"


@registered("s1_streaming_promotion", f"""
SELECT setting, coalesce(f.ts_code, o.ts_code) AS symbol, coalesce(f.trade_date, o.trade_date) AS trade_date,
  CASE WHEN f.ts_code IS NULL THEN '{_PREFIX}_001' ELSE '{_PREFIX}_002' END AS source_batch_id, {", ".join(sql.near(_LATER.format(c), 4) + " AS " + c for c in BAR)}
FROM batchf f FULL JOIN batcho o ON f.ts_code = o.ts_code AND f.trade_date = o.trade_date CROSS JOIN (VALUES ('one'), ('all')) s(setting)""")
def _(m):
    """One batch per trigger and all at once give the same table."""
    tables = [
        _streamed(m, count).current("daily_prices").select(F.lit(setting).alias("setting"), *KEY, "source_batch_id", *BAR)
        for setting, count in (("one", 1), ("all", None))
    ]
    return near(tables[0].unionByName(tables[1]), BAR, 4)


@registered("s1_stream_lineage", f"""
SELECT * FROM (VALUES ('one', '{_PREFIX}_001', 2), ('one', '{_PREFIX}_002', 2), ('all', '{_PREFIX}_001', 1), ('all', '{_PREFIX}_002', 1)) v(setting, batch_id, version)
JOIN (SELECT count(*) AS row_count FROM merged) ON true WHERE version = 2 OR setting = 'all'
UNION ALL SELECT 'one', '{_PREFIX}_001', 1, count(*) FROM batcho""")
def _(m):
    """Which versions hold each streamed batch, with the recorded rows."""
    parts = []
    for setting, count in (("one", 1), ("all", None)):
        ws = _streamed(m, count)
        order = F.dense_rank().over(Window.orderBy("created_at")).cast("int").alias("version")
        versions = ws.versions().select("curated_version_id", "row_count", order)
        parts.append(catalog.run_lineage(ws.metadata("data_batches"), ws.metadata("version_batches"), ws.metadata("curated_versions"),
            ws.spark.createDataFrame([], "snapshot_id string, curated_version_id string")).join(versions, "curated_version_id").select(
            F.lit(setting).alias("setting"), "batch_id", "version", "row_count"))
    return parts[0].unionByName(parts[1])
