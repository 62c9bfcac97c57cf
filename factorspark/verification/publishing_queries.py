"""Stored factor runs, pools, market status, analysis and published payloads (A07, A10, M7, N, P)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import market, pools, publishing
from ..operators.asof import as_of
from ..operators.signals import date_successors
from ..plans import research
from ..plans.runtime import materialise, new_path
from ..sources import artifacts
from ..sources.weekly_bars import MarketTables, security_symbol
from . import sql
from .registry import near, registered
from .research_queries import SCORES, factor_run, stored_factors
from .sql import PARTS, near_all, text, text_list


# --- stored runs ----------------------------------------------------------------

def stored_run(m: MarketTables) -> tuple[str, DataFrame]:
    root = new_path(m.spark, "runs")
    artifacts.write_factor_run(factor_run(m), root, "run_001")
    return root, artifacts.read_factor_run(m.spark, root, "run_001")


@registered("a07_factor_run_scan", f"SELECT symbol, trade_date, {near_all(['total_score'], 8)}, tradable_flag FROM factors")
def _(m):
    _, run = stored_run(m)
    return near(run.select("symbol", "trade_date", "total_score", "tradable_flag"), ["total_score"], 8)


@registered("a10_result_sinks", f"""
SELECT 'csv' AS form, factor, trade_date, sample_count, {near_all(['ic'])} FROM icbydate
UNION ALL SELECT 'json', factor, trade_date, sample_count, {near_all(['ic'])} FROM icbydate""")
def _(m):
    """IC table written as CSV and JSON and read back with a declared schema."""
    from ..operators import evaluation
    from .research_queries import pairs

    table = materialise(evaluation.ic_only(pairs(m)), "ic")
    root = new_path(m.spark, "results")
    back = None
    for form in ("csv", "json"):
        artifacts.write_result(table, root, "run_001", f"ic_{form}", form)
        rows = artifacts.read_result(m.spark, root, "run_001", f"ic_{form}", table.schema, form).withColumn("form", F.lit(form))
        back = rows if back is None else back.unionByName(rows)
    return near(back, ["ic"])


@registered("m7_evaluate_factor_run", f"""
SELECT 'ic' AS part, factor, CAST(count(*) AS BIGINT) AS rows, {sql.near('avg(rank_ic)')} AS figure FROM icbydate GROUP BY 2
UNION ALL SELECT 'coverage', factor, count(*), {sql.near('count(*)::DOUBLE / (SELECT count(*) FROM factors)')} FROM longfactors GROUP BY 2
UNION ALL SELECT 'groups', factor, count(*), {sql.near('avg(forward_return)')} FROM evaluated GROUP BY 2
UNION ALL SELECT 'mean_ic', factor, count(*), {sql.near('avg(ic)')} FROM icbydate GROUP BY 2
UNION ALL SELECT 'icir', factor, count(*), {sql.near('avg(ic) / nullif(stddev_samp(ic), 0)')} FROM icbydate GROUP BY 2
UNION ALL {" UNION ALL ".join(f"SELECT 'with_mom_20', '{c}', (SELECT count(*) FROM factors), {sql.near(sql.pearson_sql('a', 'b'))} FROM (SELECT mom_20 AS a, {c} AS b FROM factors WHERE mom_20 IS NOT NULL AND {c} IS NOT NULL)" for c in fv.EVALUATED_FACTORS)}""")
def _(m):
    """Evaluation of a stored run: IC, coverage and group returns summarised per factor."""
    _, run = stored_run(m)
    tables = research.evaluate_factors(run, m.prices, 20, 5)
    ic = tables["ic_by_date"].groupBy("factor").agg(F.count(F.lit(1)).alias("rows"), F.avg("rank_ic").alias("figure"))
    cover = tables["coverage"].select("factor", F.col("non_null_count").alias("rows"), F.col("coverage").alias("figure"))
    weighted = F.sum(F.col("avg_forward_return") * F.col("sample_count")) / F.sum("sample_count")
    groups = tables["group_returns"].groupBy("factor").agg(F.sum("sample_count").alias("rows"), weighted.alias("figure"))
    summary = materialise(tables["summary"], "summary")
    measure = lambda name: summary.select("factor", F.col("date_count").alias("rows"), F.col(name).alias("figure"))
    related = tables["correlation"].select("factor", run.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows"), F.col("mom_20").alias("figure"))
    parts = {
        "ic": ic, "coverage": cover, "groups": groups, "mean_ic": measure("mean_ic"), "icir": measure("icir"), "with_mom_20": related,
    }
    whole = reduce(DataFrame.unionByName, [frame.withColumn("part", F.lit(part)) for part, frame in parts.items()])
    return near(whole, ["figure"])


# --- N ----------------------------------------------------------------------------

_THEMES = ", ".join(f"{text(i)}: {text(t)}" for i, t in fv.INDUSTRY_THEME)


def theme_sql(column: str) -> str:
    return f"coalesce(MAP {{{_THEMES}}}[{column}], {text(fv.OTHER_THEME)})"


PARTS["pools"] = f"""
SELECT trade_date, place AS rank, symbol, name, industry AS industry_l1, {theme_sql('industry')} AS theme,
  coalesce(nullif(array_to_string(list_filter([{', '.join(f"CASE WHEN {s} >= 0.7::DOUBLE THEN {text(t)} END" for s, t in fv.REASON_LABELS)}], lambda x: x IS NOT NULL), '、'), ''), {text(fv.REASON_FALLBACK)}) AS reason_summary,
  CASE WHEN risk_score < 0.35::DOUBLE THEN 'weak_risk_score' ELSE 'none' END AS risk_summary, total_score
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY total_score DESC, symbol) AS place FROM factors WHERE tradable_flag) WHERE place <= 10"""
PARTS["poolchanges"] = """
SELECT coalesce(c.trade_date, p.trade_date) AS trade_date, coalesce(c.symbol, p.symbol) AS symbol, c.rank, p.rank AS previous_rank,
  CASE WHEN c.rank IS NULL THEN 'removed' WHEN p.rank IS NULL THEN 'newly_added' WHEN p.rank - c.rank >= 2 THEN 'upgraded'
    WHEN c.rank - p.rank >= 2 THEN 'downgraded' ELSE 'retained' END AS change_status
FROM pools c FULL JOIN (SELECT s.recommend_trade_date AS trade_date, q.symbol, q.rank FROM pools q JOIN successors s ON q.trade_date = s.trade_date
  WHERE s.recommend_trade_date IS NOT NULL) p ON c.trade_date = p.trade_date AND c.symbol = p.symbol"""
PARTS["lastpools"] = "SELECT * FROM poolchanges WHERE trade_date = (SELECT max(trade_date) FROM factors)"


@registered("n1_rank_002", f"""
SELECT place AS rank, symbol, name, trade_date, {near_all(['total_score', *SCORES], 8)}, exclusion_reason FROM (
  SELECT *, row_number() OVER (ORDER BY total_score DESC, symbol) AS place FROM factors WHERE tradable_flag AND trade_date = (SELECT max(trade_date) FROM factors)) WHERE place <= 20""")
def _(m):
    run = stored_factors(m, ["name", "total_score", *SCORES, "exclusion_reason"])
    return near(research.rank_candidate_002(run), ["total_score", *SCORES], 8)


def all_pools(m) -> DataFrame:
    return pools.pool_rows(factor_run(m), 10)


@registered("n2_candidate_pool", f"""
SELECT trade_date, rank, symbol, name, industry_l1, theme, reason_summary, risk_summary, {near_all(['total_score'], 8)} FROM pools""")
def _(m):
    return near(all_pools(m), ["total_score"], 8)


def history(m) -> DataFrame:
    """Changes of every date. The pools (at most ten rows per date) are written once
    and read for both sides."""
    return pools.pool_history(materialise(all_pools(m).select("trade_date", "symbol", "rank"), "pools"), date_successors(m.calendar))


def _last_two(m) -> tuple[DataFrame, DataFrame]:
    """Pools of the newest date and of the one before it."""
    run = stored_factors(m, ["name", "industry", "total_score", *SCORES, "exclusion_reason"])
    newest = run.agg(F.max("trade_date").alias("d")).scalar()
    before = date_successors(m.calendar)
    dated = pools.pool_rows(run, 10).select("trade_date", "symbol", "rank").join(before, "trade_date", "left")
    kept = materialise(
        dated.filter((F.col("trade_date") == newest) | (F.col("recommend_trade_date") == newest)).withColumn(
            "is_current", F.col("trade_date") == newest
        ), "last-pools")
    return kept.filter("is_current"), kept.filter("not is_current")


def _numbers(frame, names):
    return frame.withColumns({n: F.col(n).cast("double") for n in names})


@registered("n3_rank_change", """
SELECT symbol, rank::DOUBLE AS rank, previous_rank::DOUBLE AS previous_rank, change_status FROM lastpools""")
def _(m):
    return _numbers(pools.compare_pools(*_last_two(m)), ["rank", "previous_rank"])


@registered("n4_removed", "SELECT symbol, previous_rank AS rank FROM lastpools WHERE change_status = 'removed'")
def _(m):
    return pools.removed_from(*_last_two(m)).select("symbol", "rank")


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE change_status = {text(s)}) AS {s}" for s in ("newly_added", "retained", "upgraded", "downgraded", "removed")
) + ", count(*) FILTER (WHERE change_status <> 'removed') AS total"


@registered("n5_diff_summary", f"SELECT trade_date, {_COUNTS} FROM poolchanges GROUP BY trade_date")
def _(m):
    return pools.diff_summary(history(m), ["trade_date"])


@registered("n6_pool_history", """
SELECT trade_date, symbol, rank::DOUBLE AS rank, previous_rank::DOUBLE AS previous_rank, change_status FROM poolchanges""")
def _(m):
    return _numbers(history(m), ["rank", "previous_rank"])


@registered("n7_latest_factor_date", "SELECT coalesce(max(trade_date) FILTER (WHERE tradable_flag), max(trade_date)) AS trade_date FROM factors")
def _(m):
    return pools.latest_factor_date(factor_run(m))


# --- P ----------------------------------------------------------------------------

def _period(days):
    return f"""CASE WHEN count(*) OVER w{days} >= 2 THEN (last_value(close) OVER w{days} / first_value(close) OVER w{days} - 1) * 100 END AS return_{days}d"""


PARTS["indexmetrics"] = f"""
SELECT symbol, trade_date, coalesce(pct_change, 0) AS return_1d, {_period(5)}, {_period(20)}, list_position({text_list([c for c, _ in fv.BROAD_INDEXES])}, symbol) AS position,
  {text_list([r for _, r in fv.BROAD_INDEXES])}[list_position({text_list([c for c, _ in fv.BROAD_INDEXES])}, symbol)] AS role
FROM prices WHERE asset_type = 'index' AND symbol IN {sql.in_list([c for c, _ in fv.BROAD_INDEXES])}
WINDOW w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
PARTS["extremes"] = """
SELECT trade_date, max(CASE WHEN best = 1 THEN symbol END) AS strongest, max(CASE WHEN best = 1 THEN return_1d END) AS strongest_return,
  max(CASE WHEN best = n THEN symbol END) AS weakest, max(CASE WHEN best = n THEN return_1d END) AS weakest_return,
  max(CASE WHEN best = 1 THEN rank5 END) AS top5, max(CASE WHEN best = n THEN rank5 END) AS low5, max(n) AS n,
  count(*) FILTER (WHERE return_1d > 0) AS up, count(*) FILTER (WHERE return_1d < 0) AS down
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY return_1d DESC, position) AS best, count(*) OVER (PARTITION BY trade_date) AS n,
  row_number() OVER (PARTITION BY trade_date ORDER BY coalesce(return_5d, 0) DESC, position) AS rank5 FROM indexmetrics) GROUP BY trade_date"""
PARTS["sectors"] = """
SELECT d.trade_date, d.index_code, c.industry_name, d.close, coalesce(d.pct_change, 0) AS pct_change
FROM industrydaily d JOIN classification c ON d.index_code = c.index_code WHERE c.level = 'L1' AND c.source_system = 'SW2021'"""
PARTS["sectorends"] = """
SELECT * FROM (SELECT trade_date, index_code, industry_name, pct_change, 'strong' AS side, row_number() OVER (PARTITION BY trade_date ORDER BY pct_change DESC, index_code) AS place FROM sectors
UNION ALL SELECT trade_date, index_code, industry_name, pct_change, 'weak', row_number() OVER (PARTITION BY trade_date ORDER BY pct_change, index_code) FROM sectors) WHERE place <= 3"""
PARTS["cards"] = f"""
SELECT trade_date, list(industry_name ORDER BY place) FILTER (WHERE side = 'strong') AS strong_names, list(industry_name ORDER BY place) FILTER (WHERE side = 'weak') AS weak_names,
  list({theme_sql('industry_name')} ORDER BY place) FILTER (WHERE side = 'weak') AS weak_themes,
  max(CASE WHEN side = 'strong' AND place = 1 THEN pct_change END) - max(CASE WHEN side = 'weak' AND place = 1 THEN pct_change END) AS spread,
  avg(CAST(pct_change < 0 AS DOUBLE)) AS down_ratio FROM sectorends GROUP BY trade_date"""
PARTS["summary"] = """
SELECT s.trade_date, up_ratio, CASE WHEN up_ratio >= 0.7 THEN 'mostly_up' WHEN up_ratio <= 0.3 THEN 'mostly_down' WHEN spread >= 2 THEN 'divergent' ELSE 'balanced' END AS sector_summary
FROM (SELECT trade_date, avg(CAST(pct_change > 0 AS DOUBLE)) AS up_ratio FROM sectors GROUP BY 1) s JOIN cards USING (trade_date)"""
PARTS["alldays"] = "SELECT trade_date FROM calendar UNION SELECT CAST(o_orderdate AS DATE) FROM orders"
PARTS["states"] = """
SELECT d.trade_date, CASE WHEN i.trade_date IS NULL AND s.trade_date IS NULL THEN 'unavailable' WHEN i.trade_date IS NULL OR s.trade_date IS NULL THEN 'partial' ELSE 'complete' END AS status
FROM alldays d LEFT JOIN (SELECT DISTINCT trade_date FROM indexmetrics) i ON d.trade_date = i.trade_date LEFT JOIN (SELECT DISTINCT trade_date FROM sectors) s ON d.trade_date = s.trade_date"""
PARTS["risks"] = f"""
SELECT t.trade_date, array_to_string(list_slice(list_filter([CASE WHEN status <> 'complete' THEN 'data_insufficient' END,
  CASE WHEN idown >= 0.67 AND down_ratio >= 0.60 THEN 'general_weakness' END,
  CASE WHEN len(list_intersect(two, {text_list(fv.GROWTH_INDEXES)})) > 0 OR list_contains(weak_themes, {text(fv.GROWTH_THEME)}) THEN 'growth_pressure' END,
  CASE WHEN len(list_intersect(two, {text_list(fv.SMALL_CAP_INDEXES)})) > 0 THEN 'small_cap_pressure' END,
  CASE WHEN spread >= 2 THEN 'sector_divergence' END,
  CASE WHEN len(list_filter(weak_themes, lambda x: x = weak_themes[1])) >= 2 THEN 'weak_theme_concentration' END], lambda x: x IS NOT NULL), 1, 3), ',') AS risks
FROM states t LEFT JOIN (SELECT trade_date, avg(CAST(return_1d < 0 AS DOUBLE)) AS idown, list_slice(list(symbol ORDER BY return_1d, position), 1, 2) AS two
  FROM indexmetrics GROUP BY 1) i ON t.trade_date = i.trade_date LEFT JOIN cards c ON t.trade_date = c.trade_date"""


@registered("p1_index_metrics", f"SELECT symbol, trade_date, role, {near_all(['return_1d', 'return_5d', 'return_20d'])} FROM indexmetrics")
def _(m):
    return near(market.index_metrics(m.prices).drop("position"), ["return_1d", "return_5d", "return_20d"])


@registered("p2_strongest_weakest", f"SELECT trade_date, strongest, weakest, {near_all(['strongest_return', 'weakest_return'])} FROM extremes")
def _(m):
    rows = market.strongest_weakest(market.index_metrics(m.prices)).drop("strongest_reason", "weakest_reason")
    return near(rows, ["strongest_return", "weakest_return"])


@registered("p3_index_reasons", """
SELECT trade_date, CASE WHEN down = n THEN 'falls_least' WHEN up = n THEN 'leads_broad_rise' WHEN top5 <= 2 THEN 'leads_1d_and_5d' ELSE 'recovers_today' END AS strongest_reason,
  CASE WHEN up = n THEN 'rises_least' WHEN down = n THEN 'leads_broad_fall' WHEN low5 >= greatest(1, n - 1) THEN 'lags_1d_and_5d' ELSE 'falls_back_today' END AS weakest_reason FROM extremes""")
def _(m):
    return market.strongest_weakest(market.index_metrics(m.prices)).select("trade_date", "strongest_reason", "weakest_reason")


def _sectors(m):
    return market.sector_metrics(m.industry_daily, m.classification)


@registered("p4_sector_metrics", f"SELECT trade_date, index_code, industry_name, {near_all(['close'], 4)}, {near_all(['pct_change'])} FROM sectors")
def _(m):
    rows = _sectors(m).select("trade_date", "index_code", "industry_name", "close", F.coalesce("pct_change", F.lit(0.0)).alias("pct_change"))
    return near(near(rows, ["close"], 4), ["pct_change"])


@registered("p5_sector_extremes", f"SELECT trade_date, index_code, industry_name, side, place, {near_all(['pct_change'])} FROM sectorends")
def _(m):
    return near(market.sector_extremes(_sectors(m)), ["pct_change"])


@registered("p6_sector_summary", f"SELECT trade_date, {near_all(['up_ratio'])}, sector_summary FROM summary")
def _(m):
    sectors = _sectors(m)
    return near(market.sector_summary(sectors, market.sector_cards(market.sector_extremes(sectors))), ["up_ratio"])


def _days(m):
    return m.calendar.union(m.raw("orders").select(F.col("o_orderdate").cast("date")))


@registered("p7_structural_risks", "SELECT trade_date, risks FROM risks")
def _(m):
    metrics, sectors = market.index_metrics(m.prices), _sectors(m)
    states = market.status(_days(m), metrics, sectors)
    rows = market.structural_risks(metrics, market.sector_cards(market.sector_extremes(sectors)), states)
    return rows.withColumn("risks", F.array_join("risks", ","))


@registered("p8_status", "SELECT trade_date, status FROM states")
def _(m):
    return market.status(_days(m), market.index_metrics(m.prices), _sectors(m)).select("trade_date", "status")


@registered("p8_partial_status", """
SELECT d.trade_date, CASE WHEN i.trade_date IS NULL AND s.trade_date IS NULL THEN 'unavailable' WHEN i.trade_date IS NULL OR s.trade_date IS NULL THEN 'partial' ELSE 'complete' END AS status,
  concat_ws('; ', CASE WHEN i.trade_date IS NULL THEN 'missing broad index rows' END, CASE WHEN s.trade_date IS NULL THEN 'missing sector rows' END) AS warnings
FROM alldays d LEFT JOIN (SELECT DISTINCT trade_date FROM indexmetrics WHERE year(trade_date) <> 1996) i ON d.trade_date = i.trade_date
LEFT JOIN (SELECT DISTINCT trade_date FROM sectors WHERE year(trade_date) NOT IN (1997, 1998)) s ON d.trade_date = s.trade_date""")
def _(m):
    """Years without index rows, and others without sector rows."""
    metrics = market.index_metrics(m.prices).filter(F.year("trade_date") != 1996)
    states = market.status(_days(m), metrics, _sectors(m).filter(~F.year("trade_date").isin(1997, 1998)))
    return states.select("trade_date", "status", F.array_join("warnings", "; ").alias("warnings"))


@registered("p8_market_status", f"""
SELECT t.trade_date, status, strongest, weakest, sector_summary, risks, array_to_string(strong_names, ',') AS strongest_sectors, array_to_string(weak_names, ',') AS weakest_sectors
FROM states t LEFT JOIN extremes e ON t.trade_date = e.trade_date LEFT JOIN summary s ON t.trade_date = s.trade_date LEFT JOIN risks r ON t.trade_date = r.trade_date
LEFT JOIN cards c ON t.trade_date = c.trade_date""")
def _(m):
    rows = market.market_status(_days(m), m.prices, m.industry_daily, m.classification)
    joined = {c: F.array_join(c, ",") for c in ("risks", "strongest_sectors", "weakest_sectors")}
    return rows.withColumns(joined).select("trade_date", "status", "strongest", "weakest", "sector_summary", *joined)


ANALYSED = ["name", "industry", "market_segment", "exclusion_reason", *fv.ANALYSIS_FACTORS]
_EARLY = "(SELECT max(trade_date) FROM factors WHERE year(trade_date) = (SELECT min(year(trade_date)) FROM factors))"
_ASKED = f"(SELECT symbol FROM security UNION SELECT {sql._symbol('c_custkey')} FROM customer)"


@registered("p9_security_analysis", f"""
SELECT a.symbol, f.name, f.industry, f.market_segment AS market, coalesce(tradable_flag, FALSE) AS in_latest_candidate_pool,
  CASE WHEN f.symbol IS NULL THEN 'not_found_in_factor_run' ELSE exclusion_reason END AS exclusion_reason,
  {sql.near('total_score', 8)} AS total_score, {", ".join(sql.near(f'coalesce({c}, 0)', 8) + f' AS {c}' for c in ('momentum_score', 'flow_score', 'risk_score'))},
  CASE WHEN f.symbol IS NULL THEN {text(fv.NO_EVIDENCE_NOTE)} WHEN exclusion_reason = 'none' AND risk_score >= 0.35::DOUBLE THEN {text(fv.NO_RISK_NOTE)}
    ELSE concat_ws('; ', CASE WHEN exclusion_reason <> 'none' THEN exclusion_reason END, CASE WHEN risk_score < 0.35::DOUBLE THEN {text(fv.WEAK_RISK_NOTE)} END) END AS risk_notes
FROM {_ASKED} a LEFT JOIN (SELECT * FROM factors WHERE trade_date = (SELECT max(trade_date) FROM factors)) f ON a.symbol = f.symbol""")
def _(m):
    asked = m.security.select("symbol").union(m.raw("customer").select(security_symbol("c_custkey")))
    rows = publishing.analyse_securities(asked, stored_factors(m, ANALYSED))
    return near(rows.drop("factor_values").withColumn("risk_notes", F.array_join("risk_notes", "; ")),
                ["total_score", "momentum_score", "flow_score", "risk_score"], 8)


@registered("p9_factor_values", " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS factor_code, {sql.near(f'{c}::DOUBLE', 6)} AS value, {c} IS NULL AS missing_data FROM factors WHERE trade_date = {_EARLY}"
    for c in fv.ANALYSIS_FACTORS))
def _(m):
    """The factor values of each security at the end of the first year, when long look-backs are still missing."""
    run = stored_factors(m, ANALYSED)
    early = run.filter(F.year("trade_date") == run.agg(F.min(F.year("trade_date")).alias("y")).scalar())
    rows = publishing.analyse_securities(m.security.select("symbol"), early).select("symbol", F.inline("factor_values"))
    return near(rows, ["value"])


def violations_sql(column: str) -> str:
    terms = [f"CASE WHEN contains(lower({column}), {text(t)}) THEN {text('prohibited wording: ' + t)} END" for t in fv.PROHIBITED_TERMS]
    terms += [f"CASE WHEN contains(lower({column}), {text(t)}) THEN {text('forbidden sensitive field: ' + t)} END" for t in fv.SENSITIVE_TERMS]
    terms.append(f"CASE WHEN regexp_matches(lower({column}), {text(fv.LOCAL_PATH_PATTERN)}) THEN 'forbidden local absolute path' END")
    return f"array_to_string(list_filter([{', '.join(terms)}], lambda x: x IS NOT NULL), '; ')"


def _violations(rows, keys, column, text_of=None):
    found = publishing.with_wording_violations(rows.select(*keys, column), F.col(column) if text_of is None else text_of, "found")
    return found.select(*keys, F.array_join("found", "; ").alias("violations"))


@registered("p10_wording_documents", f"SELECT doc_id, {violations_sql('text')} AS violations FROM documents")
def _(m):
    return _violations(m.raw("documents"), ["doc_id"], "text")


_SPOKEN = "replace(replace(text, 'th', ' Sell'), 'on', 'D:/on')"


@registered("p10_wording_conversations", f"SELECT conv_id, turn, {violations_sql(_SPOKEN)} AS violations FROM conversations")
def _(m):
    """The turns with words put in that must not be published."""
    return _violations(m.raw("conversations"), ["conv_id", "turn"], "text", F.expr(_SPOKEN))


_SHOWN = "replace(replace(html, 'of the', '目标价'), 'ad 1', 'raw_payload')"


@registered("p10_wording_pages", f"SELECT page_id, {violations_sql(_SHOWN)} AS violations FROM pages")
def _(m):
    return _violations(m.raw("pages"), ["page_id"], "html", F.expr(_SHOWN))


def _bundles(m):
    """Payloads of every pool date, the pool of the date before as the previous version."""
    states = market.market_status(m.calendar, m.prices, m.industry_daily, m.classification)
    found = materialise(all_pools(m), "pools")
    successors = date_successors(m.calendar)
    changes = pools.with_previous_version(pools.pool_history(found, successors), found, successors)
    return publishing.daily_bundles(publishing.market_payloads(states), publishing.candidate_payloads(found, changes))


#: Day of the year modulo 6 -> what is done to the bundle, and what the check has to say.
_DAMAGE = {
    0: "", 1: "missing section: sectors", 2: "unsupported candidate_pool schema_version", 3: "prohibited wording: sell",
    4: "bundle_hash mismatch", 5: "missing section: candidate_pool_metadata; unsupported candidate_pool schema_version",
}


def _damaged(bundles):
    kind = F.dayofyear("trade_date") % 6
    pool, market_status = F.col("candidate_pool"), F.col("market_status")
    version = pool["candidate_pool_metadata"].withField("schema_version", F.lit("candidate_pool_v000"))
    nothing = lambda path: F.lit(None).cast(bundles.select(path).schema[0].dataType)
    before = bundles.withColumns({
        "market_status": F.when(kind == 1, market_status.withField("sectors", nothing("market_status.sectors")))
        .when(kind == 3, market_status.withField("structural_risks", F.array(F.lit("Sell everything")))).otherwise(market_status),
        "candidate_pool": F.when(kind == 2, pool.withField("candidate_pool_metadata", version))
        .when(kind == 5, pool.withField("candidate_pool_metadata", nothing("candidate_pool.candidate_pool_metadata"))).otherwise(pool),
    })
    hashed = publishing.with_bundle_hash(before)
    meta = F.col("bundle_metadata")
    return hashed.withColumn("bundle_metadata", F.when(kind == 4, meta.withField("bundle_id", F.lit("other"))).otherwise(meta))


@registered("p11_payload_checks", f"""
SELECT p.trade_date, s.status, newly_added, removed, total,
  CASE dayofyear(p.trade_date) % 6 {" ".join(f"WHEN {k} THEN {text(v)}" for k, v in _DAMAGE.items())} END AS errors
FROM (SELECT trade_date, CAST(count(*) FILTER (WHERE change_status = 'newly_added') AS INTEGER) AS newly_added,
  CAST(count(*) FILTER (WHERE change_status = 'removed') AS INTEGER) AS removed, CAST(count(*) FILTER (WHERE change_status <> 'removed') AS INTEGER) AS total
  FROM poolchanges GROUP BY 1) p JOIN states s ON p.trade_date = s.trade_date WHERE total > 0""")
def _(m):
    """Bundles of all dates, five in six of them damaged in one way each."""
    return publishing.with_bundle_errors(_damaged(_bundles(m))).select(
        "trade_date", "market_status.market_status_metadata.status", "candidate_pool.summary.newly_added",
        "candidate_pool.summary.removed", "candidate_pool.summary.total", F.array_join("errors", "; ").alias("errors"),
    )


@registered("p12_latest_quotes", f"""
SELECT symbol, trade_date AS quote_date, {sql.near('close', 4)} AS last_price, {sql.near('coalesce(pct_change, 0)')} AS change_percent
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM prices)
WHERE n = 1 AND symbol IN (SELECT {sql._symbol('c_custkey')} FROM customer)""")
def _(m):
    watched = m.raw("customer").select(security_symbol("c_custkey").alias("symbol"))
    return near(near(publishing.latest_quotes(watched, m.prices), ["last_price"], 4), ["change_percent"])


@registered("p12_quotes_as_of", f"""
SELECT w.symbol, w.as_of_date, q.trade_date AS quote_date, {sql.near('q.close', 4)} AS last_price, {sql.near('q.pct_change')} AS change_percent
FROM (SELECT DISTINCT {sql._symbol('o_custkey')} AS symbol, CAST(o_orderdate AS DATE) AS as_of_date FROM orders) w
ASOF LEFT JOIN (SELECT symbol, trade_date, close, pct_change FROM prices) q ON w.symbol = q.symbol AND w.as_of_date >= q.trade_date""")
def _(m):
    """Every date on which a customer ordered, with the last quote of their security at or before it."""
    watched = m.raw("orders").select(
        security_symbol("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("as_of_date")).distinct()
    quotes = m.prices.select("symbol", "trade_date", "close", "pct_change")
    rows = as_of(watched, quotes).select(
        "symbol", "as_of_date", F.col("found.trade_date").alias("quote_date"), F.col("found.close").alias("last_price"),
        F.col("found.pct_change").alias("change_percent"))
    return near(near(rows, ["last_price"], 4), ["change_percent"])


@registered("p13_unpublished", """
SELECT DISTINCT trade_date, trade_date > DATE '2001-06-30' AS is_new FROM pools
WHERE trade_date > DATE '2001-06-30' OR trade_date = (SELECT min(trade_date) FROM pools)""")
def _(m):
    """Bundles up to a date were published, the first of them with another content since; the rest is new."""
    last = F.lit("2001-06-30").cast("date")
    bundles = materialise(publishing.with_bundle_hash(_bundles(m)), "bundles").select("trade_date", "bundle_metadata.bundle_hash")
    first = bundles.agg(F.min("trade_date").alias("d")).scalar()
    published = bundles.filter(F.col("trade_date") <= last).withColumn(
        "bundle_hash", F.when(F.col("trade_date") == first, F.sha2("bundle_hash", 256)).otherwise(F.col("bundle_hash"))
    )
    return publishing.unpublished(bundles, published).select("trade_date", (F.col("trade_date") > last).alias("is_new"))
