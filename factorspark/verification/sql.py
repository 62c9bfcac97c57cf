"""Building blocks of the DuckDB statements the results are checked against.

Each entry of PARTS is one common table expression over the given tables; `query`
puts the needed ones in front of a SELECT.
"""

from __future__ import annotations

import re

from ..functions import fixed_values as fv


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def near(expression: str, digits: int = 6) -> str:
    """Rounding that both engines compute with the same operations."""
    return f"floor(({expression}) * 1e{digits} + 0.5001) / 1e{digits}"


def near_all(names, digits: int = 6) -> str:
    return ", ".join(f"{near(n, digits)} AS {n}" for n in names)


def log_all(names, digits: int = 6) -> str:
    return ", ".join(f"{near(f'sign({n}) * ln(1 + abs({n}))', digits)} AS {n}" for n in names)


PARTS: dict[str, str] = {}


def query(select: str) -> str:
    """Prefix `select` with every part it mentions, directly or through other parts."""
    needed: list[str] = []

    def collect(sql: str, owner: str = ""):
        for name, part in PARTS.items():
            if name != owner and name not in needed and re.search(rf"\b{name}\b", sql):
                collect(part, name)
                if name not in needed:
                    needed.append(name)

    collect(select)
    if not needed:
        return select
    parts = ",\n".join(
        f"{n} AS ({PARTS[n]})" if n.startswith("rec_") else f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needed
    )
    return f"WITH RECURSIVE {parts}\n{select}"


def _symbol(key: str) -> str:
    return f"concat('S', {key}, [ '.SH', '.SZ', '.BJ' ][{key} % 3 + 1])"


_INDUSTRY = f"coalesce({text_list([i for i, _ in fv.INDUSTRY_THEME])}[n_nationkey + 1], n_name)"
_INDEX = f"coalesce({text_list([c for c, _ in fv.BROAD_INDEXES])}[r_regionkey + 1], concat('IDX_', r_name))"

_BAR_SUMS = """
  sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS amount,
  sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS volume,
  sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END)::DOUBLE AS open_amount,
  sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,2)) END)::DOUBLE AS open_volume,
  max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low
"""

PARTS["weeks"] = "SELECT *, CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem"
PARTS["stockbars"] = f"""
SELECT symbol, trade_date, open_amount / open_volume AS open, high, low, amount / volume AS close, volume, amount,
  CASE WHEN NOT tiny THEN 1.0::DOUBLE + max_tax END AS adj_factor, tiny AS is_suspended,
  CASE WHEN max_tax > 0.01 THEN volume / 100.0::DOUBLE END AS turnover_rate,
  inflow AS main_net_inflow, inflow / amount * 100.0::DOUBLE AS main_net_inflow_rate,
  profit_volume / volume * 100.0::DOUBLE AS close_profit_ratio
FROM (SELECT {_symbol('l_suppkey')} AS symbol, week AS trade_date, {_BAR_SUMS},
  max(l_tax) AS max_tax, max(l_quantity) < 3 AS tiny,
  sum(CAST(CASE l_returnflag WHEN 'N' THEN l_extendedprice WHEN 'R' THEN -l_extendedprice ELSE 0 END AS DECIMAL(18,2)))::DOUBLE AS inflow,
  sum(CAST(CASE WHEN l_discount >= 0.02::DOUBLE THEN l_quantity ELSE 0 END AS DECIMAL(18,2)))::DOUBLE AS profit_volume
  FROM weeks GROUP BY l_suppkey, week)"""
PARTS["places"] = f"""
SELECT s_suppkey, s_name, s_acctbal, n_nationkey, n_name, r_regionkey, r_name, {_INDUSTRY} AS industry, {_INDEX} AS index_symbol
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
PARTS["indexbars"] = f"""
SELECT symbol, trade_date, open_amount / open_volume AS open, high, low, amount / volume AS close, volume, amount
FROM (SELECT index_symbol AS symbol, week AS trade_date, {_BAR_SUMS}
  FROM weeks JOIN places ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
PARTS["prices"] = """
SELECT symbol, trade_date, asset_type, open, high, low, close, volume, amount, adj_factor, is_suspended, turnover_rate,
  pre_close, (close / pre_close - 1) * 100 AS pct_change,
  CASE WHEN asset_type = 'stock' THEN pre_close * 1.1::DOUBLE END AS limit_up,
  CASE WHEN asset_type = 'stock' THEN pre_close * 0.9::DOUBLE END AS limit_down
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pre_close FROM (
  SELECT symbol, trade_date, 'stock' AS asset_type, open, high, low, close, volume, amount, adj_factor, is_suspended, turnover_rate FROM stockbars
  UNION ALL
  SELECT symbol, trade_date, 'index', open, high, low, close, volume, amount, NULL, NULL, NULL FROM indexbars))"""
PARTS["flow"] = f"""
SELECT symbol, trade_date, main_net_inflow, main_net_inflow_rate, close_profit_ratio, {text(fv.FLOW_METHOD)} AS data_method FROM stockbars"""
PARTS["rawsecurity"] = f"""
SELECT {_symbol('s_suppkey')} AS ts_code, CAST(s_suppkey AS VARCHAR) AS symbol,
  concat(CASE WHEN s_suppkey % 17 = 0 THEN '*ST ' ELSE '' END, s_name) AS name, r_name AS area, industry,
  CASE WHEN s_suppkey % 2 = 0 THEN ['主板', '主板', '北交所'][s_suppkey % 3 + 1] ELSE ['科创板', '创业板', '北交所'][s_suppkey % 3 + 1] END AS market,
  first_ship AS list_date, s_acctbal
FROM places LEFT JOIN (SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS first_ship FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey"""
PARTS["security"] = """
SELECT ts_code AS symbol, symbol AS raw_symbol, split_part(ts_code, '.', 2) AS exchange, 'stock' AS asset_type, name, market,
  CASE split_part(ts_code, '.', 2) || market WHEN 'SH主板' THEN 'sh_main' WHEN 'SH科创板' THEN 'star' WHEN 'SZ主板' THEN 'sz_main'
    WHEN 'SZ创业板' THEN 'chinext' WHEN 'BJ北交所' THEN 'bj' ELSE 'unknown' END AS market_segment,
  CASE split_part(ts_code, '.', 2) || market WHEN 'SH主板' THEN '上证主板' WHEN 'SH科创板' THEN '科创板' WHEN 'SZ主板' THEN '深市主板'
    WHEN 'SZ创业板' THEN '创业板' WHEN 'BJ北交所' THEN '北交所' ELSE '未知' END AS market_segment_name,
  area, industry, list_date, CAST(NULL AS DATE) AS delist_date, CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
FROM rawsecurity"""
PARTS["calendar"] = "SELECT DISTINCT week AS trade_date FROM weeks"
PARTS["successors"] = "SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS recommend_trade_date FROM calendar"
PARTS["classification"] = f"""
SELECT concat('I', n_nationkey) AS index_code, {_INDUSTRY} AS industry_name, 'L1' AS level, 'SW2021' AS source_system, concat('R', n_regionkey) AS parent_code FROM nation
UNION ALL SELECT concat('R', r_regionkey), r_name, 'L0', 'SW2021', NULL FROM region"""
PARTS["industrydaily"] = f"""
SELECT *, (close / pre_close - 1) * 100 AS pct_change FROM (
  SELECT *, lag(close) OVER (PARTITION BY index_code ORDER BY trade_date) AS pre_close FROM (
    SELECT index_code, trade_date, open_amount / open_volume AS open, high, low, amount / volume AS close, volume, amount
    FROM (SELECT concat('I', n_nationkey) AS index_code, week AS trade_date, {_BAR_SUMS}
      FROM weeks JOIN places ON l_suppkey = s_suppkey GROUP BY 1, 2)))"""

PARTS["adjusted"] = """
SELECT * EXCLUDE (latest), close * CASE WHEN adj_factor IS NULL OR latest IS NULL OR latest = 0 THEN 1.0::DOUBLE ELSE adj_factor / latest END AS adj_close,
  open * CASE WHEN adj_factor IS NULL OR latest IS NULL OR latest = 0 THEN 1.0::DOUBLE ELSE adj_factor / latest END AS adj_open
FROM (SELECT *, last_value(adj_factor IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM prices)"""
PARTS["stocks"] = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS seq FROM adjusted WHERE asset_type = 'stock'"
PARTS["rec_macd"] = """
SELECT symbol, trade_date, seq, adj_close AS ema12, adj_close AS ema26, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS dea,
  CAST(NULL AS DOUBLE) AS prev_dif, CAST(NULL AS DOUBLE) AS prev_dea FROM stocks WHERE seq = 1
UNION ALL
SELECT symbol, trade_date, seq, f, s, f - s, (f - s) * 0.2::DOUBLE + dea * 0.8::DOUBLE, dif, dea
FROM (SELECT n.symbol, n.trade_date, n.seq, m.dif, m.dea,
  n.adj_close * (2.0::DOUBLE / 13) + m.ema12 * (11.0::DOUBLE / 13) AS f, n.adj_close * (2.0::DOUBLE / 27) + m.ema26 * (25.0::DOUBLE / 27) AS s
  FROM rec_macd m JOIN stocks n ON n.symbol = m.symbol AND n.seq = m.seq + 1)"""
PARTS["macd"] = "SELECT *, prev_dif <= prev_dea AND dif > dea AS macd_golden_cross FROM rec_macd"
PARTS["momentum"] = "SELECT symbol, trade_date, adj_close / lag(adj_close, 20) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS return_20d FROM stocks"
PARTS["signals"] = """
SELECT symbol, trade_date, name, close, amount, adj_close, main_net_inflow_rate, close_profit_ratio, return_20d, macd_golden_cross
FROM stocks JOIN macd USING (symbol, trade_date) JOIN momentum USING (symbol, trade_date)
JOIN flow USING (symbol, trade_date) JOIN security USING (symbol)
WHERE status = 'active' AND name NOT LIKE '%ST%' AND amount > 0 AND main_net_inflow_rate > 0 AND macd_golden_cross AND close_profit_ratio > 80"""
PARTS["rankedsignals"] = """
SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY main_net_inflow_rate DESC, close_profit_ratio DESC, return_20d DESC NULLS FIRST, symbol) AS place FROM signals"""


def exits(days: int, table: str = "adjusted") -> str:
    ahead = lambda c, n: f"lead({c}, {n}) OVER w"
    return f"""
SELECT symbol, trade_date, {ahead('trade_date', 1)} AS recommend_trade_date,
  coalesce({ahead('open', 1)}, {ahead('close', 1)}) AS raw_entry_price,
  coalesce({ahead('adj_open', 1)}, {ahead('adj_close', 1)}) AS entry_price,
  {ahead('trade_date', days + 1)} AS exit_trade_date, {ahead('close', days + 1)} AS raw_exit_price,
  {ahead('adj_close', days + 1)} AS exit_price, {ahead('adj_close', days + 1)} / coalesce({ahead('adj_open', 1)}, {ahead('adj_close', 1)}) - 1 AS forward_return
FROM {table} WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"""


for _days in (1, 3, 5, 10, 20):
    PARTS[f"exits{_days}"] = exits(_days)
PARTS["trades"] = "SELECT * FROM rankedsignals JOIN exits20 USING (symbol, trade_date) WHERE place <= 10 AND forward_return IS NOT NULL"
PARTS["portfolio"] = "SELECT trade_date, avg(forward_return) AS portfolio_return, list_sort(list(symbol)) AS symbols FROM trades GROUP BY trade_date"


def return_statistics(portfolio: str, per_year: str, keys: str = "") -> str:
    """Return metrics of a portfolio table; `keys` is '' or 'a, b, '."""
    over = f"PARTITION BY {keys.rstrip(', ')} " if keys else ""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""
SELECT {keys} total_return, period_count, max_drawdown, annual_return, annual_volatility,
  annual_return / nullif(annual_volatility, 0) AS sharpe_ratio, annual_return / nullif(abs(max_drawdown), 0) AS calmar_ratio
FROM (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, {per_year} / period_count) - 1 ELSE -1 END AS annual_return,
    deviation * sqrt({per_year}) AS annual_volatility
  FROM (SELECT {keys} product(1 + portfolio_return) - 1 AS total_return, count(*) AS period_count,
      coalesce(stddev_samp(portfolio_return), 0) AS deviation, min(least(0, equity / greatest(1, peak) - 1)) AS max_drawdown
    FROM (SELECT *, max(equity) OVER ({over}ORDER BY trade_date) AS peak
      FROM (SELECT *, product(1 + portfolio_return) OVER ({over}ORDER BY trade_date) AS equity FROM {portfolio}))
    {group}))"""


def benchmark_statistics(portfolio: str, exits_part: str, per_year: str, symbols) -> str:
    named = ", ".join(f"({text(s)}, {i})" for i, s in enumerate(symbols, start=1))
    return f"""
SELECT benchmark_symbol, position, benchmark_return, matched - benchmark_return AS excess_return, tracking_error,
  mean_excess * {per_year} / nullif(tracking_error, 0) AS information_ratio, missing_dates
FROM (SELECT benchmark_symbol, position, product(1 + b) - 1 AS benchmark_return,
    product(CASE WHEN b IS NOT NULL THEN 1 + portfolio_return END) - 1 AS matched,
    CASE WHEN count(b) > 0 THEN coalesce(stddev_samp(portfolio_return - b), 0) * sqrt({per_year}) END AS tracking_error,
    avg(portfolio_return - b) AS mean_excess, count(*) - count(b) AS missing_dates
  FROM (SELECT k.benchmark_symbol, k.position, p.trade_date, p.portfolio_return, e.forward_return AS b
    FROM {portfolio} p JOIN (VALUES {named}) k(benchmark_symbol, position) ON TRUE
    LEFT JOIN {exits_part} e ON e.symbol = k.benchmark_symbol AND e.trade_date = p.trade_date)
  GROUP BY 1, 2)"""


# --- factor frame ------------------------------------------------------------

PARTS["priceind"] = """
SELECT *, CASE WHEN count(daily_return) OVER w20 >= 20 THEN stddev_samp(daily_return) OVER w20 END AS vol_20,
  CASE WHEN count(CASE WHEN daily_return < 0 THEN daily_return END) OVER w20 >= 20
    THEN stddev_samp(CASE WHEN daily_return < 0 THEN daily_return END) OVER w20 END AS downside_vol_20
FROM (SELECT *, adj_close / lag(adj_close) OVER w - 1 AS daily_return,
    adj_close / lag(adj_close, 20) OVER w - 1 AS mom_20, adj_close / lag(adj_close, 60) OVER w - 1 AS mom_60,
    CASE WHEN count(adj_close) OVER w20 >= 20 THEN adj_close / avg(adj_close) OVER w20 - 1 END AS ma_strength,
    CASE WHEN count(amount) OVER w20 >= 20 THEN avg(amount) OVER w20 END AS avg_amount_20,
    CASE WHEN count(amount) OVER w20 >= 20 THEN stddev_samp(amount) OVER w20 / avg(amount) OVER w20 END AS turnover_stability,
    CASE WHEN count(adj_close) OVER w60 >= 60 THEN adj_close / max(adj_close) OVER w60 - 1 END AS max_drawdown_60
  FROM stocks WINDOW w AS (PARTITION BY symbol ORDER BY trade_date),
    w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
WINDOW w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
PARTS["flowind"] = """
SELECT symbol, trade_date, close_profit_ratio AS winner_rate,
  CASE WHEN count(main_net_inflow_rate) OVER w5 >= 5 THEN sum(main_net_inflow_rate) OVER w5 END AS flow_5d,
  CASE WHEN count(main_net_inflow_rate) OVER w20 >= 20 THEN sum(main_net_inflow_rate) OVER w20 END AS flow_20d,
  CASE WHEN count(main_net_inflow_rate) OVER w10 >= 10 THEN avg(CAST(main_net_inflow_rate > 0 AS DOUBLE)) OVER w10 END AS flow_persistence,
  close_profit_ratio - lag(close_profit_ratio, 5) OVER w AS winner_rate_change_5d,
  close_profit_ratio - lag(close_profit_ratio, 20) OVER w AS winner_rate_change_20d
FROM flow WINDOW w AS (PARTITION BY symbol ORDER BY trade_date),
  w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w10 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
  w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
PARTS["assembled"] = """
SELECT p.*, f.* EXCLUDE (symbol, trade_date), s.name, s.market_segment, s.industry, s.list_date, s.status, m.macd_golden_cross AS macd_signal
FROM priceind p LEFT JOIN flowind f ON p.symbol = f.symbol AND p.trade_date = f.trade_date
LEFT JOIN security s ON p.symbol = s.symbol JOIN macd m ON p.symbol = m.symbol AND p.trade_date = m.trade_date"""


def average_rank_sql(column: str, group: str) -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL THEN rank() OVER (PARTITION BY {group} ORDER BY {column} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {group}, {column}) - 1) / 2.0::DOUBLE END"
    )


def score_sql(column: str, inverse: bool = False) -> str:
    rank = average_rank_sql(column, "trade_date")
    count = f"count({column}) OVER (PARTITION BY trade_date)"
    # the divisor is only 0 on dates where the rank is null anyway
    score = f"({rank}) / nullif({count}, 0)"
    if inverse:
        score = f"1.0::DOUBLE - {score} + 1.0::DOUBLE / nullif({count}, 0)"
    return f"coalesce({score}, 0.0::DOUBLE)"


# column, smaller is better, name of its score
SCORED = [
    ("mom_20", False), ("mom_60", False), ("ma_strength", False), ("flow_5d", False), ("flow_20d", False),
    ("flow_persistence", False), ("vol_20", True), ("max_drawdown_60", False), ("downside_vol_20", True),
    ("avg_amount_20", False), ("turnover_stability", True),
]
PARTS["ranks"] = "SELECT *, " + ", ".join(f"{score_sql(c, inv)} AS s_{c}" for c, inv in SCORED) + " FROM assembled"
PARTS["scored"] = """
SELECT *, momentum_score * 0.30::DOUBLE + flow_score * 0.25::DOUBLE + chip_score * 0.15::DOUBLE + risk_score * 0.15::DOUBLE + liquidity_score * 0.15::DOUBLE AS total_score
FROM (SELECT *,
  s_mom_20 * 0.35::DOUBLE + s_mom_60 * 0.35::DOUBLE + s_ma_strength * 0.20::DOUBLE + CAST(coalesce(macd_signal, FALSE) AS DOUBLE) * 0.10::DOUBLE AS momentum_score,
  s_flow_5d * 0.40::DOUBLE + s_flow_20d * 0.30::DOUBLE + s_flow_persistence * 0.30::DOUBLE AS flow_score,
  s_vol_20 * 0.40::DOUBLE + s_max_drawdown_60 * 0.40::DOUBLE + s_downside_vol_20 * 0.20::DOUBLE AS risk_score,
  s_avg_amount_20 * 0.70::DOUBLE + s_turnover_stability * 0.30::DOUBLE AS liquidity_score,
  coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - abs(winner_rate - 80.0::DOUBLE) / 30.0::DOUBLE)) + 0 * winner_rate, 0.0::DOUBLE) AS chip_score
  FROM ranks)"""
PARTS["factors"] = f"""
SELECT *, exclusion_reason = 'none' AS tradable_flag, {text(fv.FACTOR_VERSION)} AS factor_version FROM (SELECT *, CASE
  WHEN coalesce(status, 'unknown') <> 'active' THEN 'inactive_security'
  WHEN coalesce(name, '') LIKE '%ST%' THEN 'st_security'
  WHEN coalesce(is_suspended, FALSE) THEN 'suspended'
  WHEN limit_up IS NOT NULL AND close >= limit_up THEN 'limit_up'
  WHEN list_date IS NOT NULL AND datediff('day', list_date, trade_date) < 120 THEN 'listing_age_lt_120'
  WHEN coalesce(avg_amount_20, 0) < 50000 THEN 'low_liquidity' ELSE 'none' END AS exclusion_reason FROM scored)"""
PARTS["longfactors"] = " UNION ALL ".join(
    f"SELECT symbol, trade_date, {text(c)} AS factor, {c} AS value FROM factors WHERE {c} IS NOT NULL" for c in fv.EVALUATED_FACTORS
)
PARTS["evaluated"] = """
SELECT l.symbol, l.trade_date, factor, value, forward_return FROM longfactors l JOIN exits20 e ON l.symbol = e.symbol AND l.trade_date = e.trade_date
WHERE forward_return IS NOT NULL"""


def pearson_sql(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


PARTS["icbydate"] = f"""
SELECT factor, trade_date, {pearson_sql('value', 'forward_return')} AS ic, {pearson_sql('value_rank', 'return_rank')} AS rank_ic, count(*) AS sample_count
FROM (SELECT *, row_number() OVER (PARTITION BY factor, trade_date ORDER BY value, symbol)::DOUBLE AS value_rank,
  row_number() OVER (PARTITION BY factor, trade_date ORDER BY forward_return, symbol)::DOUBLE AS return_rank FROM evaluated)
GROUP BY 1, 2 HAVING count(*) >= 3"""


def factor_trades_sql(rebalance: str, top: int) -> str:
    exits_part, dates = ("exits1", "") if rebalance == "daily" else (
        "exits5", "AND trade_date IN (SELECT min(trade_date) FROM factors GROUP BY date_trunc('week', trade_date))")
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY total_score DESC, symbol) AS place
  FROM factors WHERE tradable_flag {dates}) JOIN {exits_part} USING (symbol, trade_date)
WHERE place <= {top} AND forward_return IS NOT NULL"""


PARTS["weeklytrades"] = factor_trades_sql("weekly", 10)
PARTS["dailytrades"] = factor_trades_sql("daily", 10)
for _kind in ("weekly", "daily"):
    PARTS[f"{_kind}portfolio"] = f"SELECT trade_date, avg(forward_return) AS portfolio_return, list_sort(list(symbol)) AS symbols FROM {_kind}trades GROUP BY trade_date"
