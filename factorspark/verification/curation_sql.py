"""SQL parts of the provider-shaped batches and run records."""

from __future__ import annotations

from ..sources.schemas import RAW_TARGET
from .sql import PARTS, _symbol, text_list

PARTS["rawdaily"] = f"""
SELECT concat('batch_', l_linestatus) AS batch_id, {_symbol('l_suppkey')} AS ts_code, week AS trade_date,
  (sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END))::DOUBLE / (sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END))::DOUBLE AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  (sum(CAST(l_extendedprice AS DECIMAL(18,2))))::DOUBLE / (sum(CAST(l_quantity AS DECIMAL(18,2))))::DOUBLE AS close,
  (sum(CAST(l_quantity AS DECIMAL(18,2))))::DOUBLE AS volume, (sum(CAST(l_extendedprice AS DECIMAL(18,2))))::DOUBLE AS amount
FROM weeks GROUP BY l_linestatus, l_suppkey, week"""
PARTS["maxima"] = f"""
SELECT {_symbol('l_suppkey')} AS symbol, week AS trade_date, max(l_tax) AS max_tax, max(l_quantity) AS max_quantity, max(l_discount) AS max_discount
FROM weeks GROUP BY l_suppkey, week"""
PARTS["batchf"] = "SELECT * FROM rawdaily WHERE batch_id = 'batch_F'"
PARTS["batcho"] = "SELECT * FROM rawdaily WHERE batch_id = 'batch_O'"
PARTS["merged"] = """
SELECT coalesce(f.ts_code, o.ts_code) AS symbol, coalesce(f.trade_date, o.trade_date) AS trade_date, coalesce(o.open, f.open) AS open,
  coalesce(o.high, f.high) AS high, coalesce(o.low, f.low) AS low, coalesce(o.close, f.close) AS close,
  coalesce(o.volume, f.volume) AS volume, coalesce(o.amount, f.amount) AS amount, coalesce(o.batch_id, f.batch_id) AS source_batch_id
FROM batchf f FULL JOIN batcho o ON f.ts_code = o.ts_code AND f.trade_date = o.trade_date"""
PARTS["rawcalendar"] = """
SELECT day, day = CAST(date_trunc('week', day) AS DATE) AS is_open FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"""
_TARGETS = ", ".join(f"'{k}': '{v}'" for k, v in RAW_TARGET.items())
PARTS["batches"] = f"""
SELECT *, MAP {{{_TARGETS}}}[dataset_name] AS dataset_id FROM (
SELECT concat('batch_', o_orderkey) AS batch_id, o_orderpriority AS source, {text_list(RAW_TARGET)}[o_custkey % {len(RAW_TARGET)} + 1] AS dataset_name,
  CAST(o_orderdate AS DATE) AS retrieved_at, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
  coalesce(n, 0) AS row_count, concat('S', o_custkey) AS customer
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
PARTS["versionbatches"] = "SELECT *, concat(dataset_id, '_', strftime(retrieved_at, '%Y%m%d')) AS curated_version_id FROM batches"
PARTS["versions"] = """
SELECT *, CASE WHEN date_trunc('month', lag(created_at) OVER t) = date_trunc('month', created_at) THEN lag(curated_version_id) OVER t END AS predecessor_id
FROM (SELECT curated_version_id, dataset_id, retrieved_at AS created_at, sum(row_count)::BIGINT AS row_count, count(*) AS batch_count FROM versionbatches GROUP BY 1, 2, 3)
WINDOW t AS (PARTITION BY dataset_id ORDER BY created_at, curated_version_id)"""
PARTS["snapshotversions"] = "SELECT concat('snapshot_', strftime(created_at, '%Y%m'), '01_001') AS snapshot_id, curated_version_id FROM versions"
PARTS["activeversions"] = """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, curated_version_id DESC) = 1 THEN 'active' ELSE 'inactive' END AS status FROM versions"""
