from datetime import date

import pytest
from pyspark.sql import functions as F

from factorspark.operators import market, publishing
from factorspark.plans import research

FIRST, DAY = date(2025, 9, 1), date(2025, 9, 4)
DAYS = [FIRST, date(2025, 9, 2), date(2025, 9, 3), DAY]

# closes of four days and the change of the last one
INDEXES = """
000300.SH  50 51 52 53   0.9
000905.SH  80 79 78 76  -0.4
000852.SH  60 58 57 54  -1.6
399006.SZ  20 21 22 25   2.2
000688.SH  40 40 41 41   0.5
899050.BJ  30 30 30 29  -0.8
"""
# industry, code, change on the last day
SECTORS = """
银行    801780.SI   3.1
煤炭    801950.SI   2.0
汽车    801880.SI   0.4
传媒    801760.SI  -1.0
计算机  801750.SI  -2.2
"""


def index_rows(spark, changes=None):
    rows = []
    for line in INDEXES.split("\n")[1:-1]:
        symbol, *closes, change = line.split()
        for day, close in zip(DAYS, closes):
            moved = float(change) if day == DAY else 0.0
            rows.append((symbol, day, "index", float(close), (changes or {}).get(symbol, moved)))
    return spark.createDataFrame(rows, "symbol string, trade_date date, asset_type string, close double, pct_change double")


def sector_rows(spark, changes=None):
    parsed = [line.split() for line in SECTORS.split("\n")[1:-1]]
    daily = spark.createDataFrame(
        [(code, name, DAY, 10.0, (changes or {}).get(name, float(change))) for name, code, change in parsed],
        "index_code string, industry_name string, trade_date date, close double, pct_change double",
    )
    classes = spark.createDataFrame(
        [(code, name, "L1", "SW2021") for name, code, _ in parsed] + [("1.SI", "通信设备", "L2", "SW2021")],
        "index_code string, industry_name string, level string, source_system string",
    )
    return daily, classes


def status_of(spark, indexes=None, sectors=None, day="2025-09-04"):
    return research.build_market_status(index_rows(spark, indexes), *sector_rows(spark, sectors), day).first()


def test_status_of_a_mixed_day(spark):
    row = status_of(spark)
    assert (row.status, row.strongest, row.strongest_return, row.weakest, row.weakest_return) == (
        "complete", "399006.SZ", 2.2, "000852.SH", -1.6)
    assert row.strongest_sectors == ["银行", "煤炭", "汽车"] and row.weakest_sectors == ["计算机", "传媒", "汽车"]
    # three of five sectors rise; 3.1 and -2.2 lie more than two points apart
    assert row.up_ratio == pytest.approx(0.6) and row.sector_summary == "divergent"
    # over the four days the first gained 25 %, more than any other, and the last lost 10 %, more than any other
    assert (row.strongest_reason, row.weakest_reason) == ("leads_1d_and_5d", "lags_1d_and_5d")
    # weakest two: both small-cap indexes; the two weakest sectors share the growth theme
    assert row.risks == ["growth_pressure", "small_cap_pressure", "sector_divergence"]


def test_index_returns_span_the_rows_there_are(spark):
    rows = {(r.symbol, r.trade_date): (r.return_5d, r.return_20d) for r in market.index_metrics(index_rows(spark)).collect()}
    assert rows["399006.SZ", DAY] == pytest.approx((25.0, 25.0)) and rows["000852.SH", DAY] == pytest.approx((-10.0, -10.0))
    assert rows["000300.SH", FIRST] == (None, None) and rows["000300.SH", DAYS[1]] == pytest.approx((2.0, 2.0))


def test_days_without_one_input_are_partial(spark):
    daily, classes = sector_rows(spark)
    row = research.build_market_status(index_rows(spark), daily.limit(0), classes, "2025-09-04").first()
    assert row.status == "partial" and row.risks[0] == "data_insufficient" and row.warnings == ["missing sector rows"]
    row = research.build_market_status(index_rows(spark).limit(0), daily, classes, "2025-09-04").first()
    assert row.status == "partial" and row.warnings == ["missing broad index rows"] and row.strongest is None
    empty = status_of(spark, day="2025-12-24")
    assert empty.status == "unavailable" and len(empty.warnings) == 2


def test_reasons_when_everything_moves_together(spark):
    codes = [line.split()[0] for line in INDEXES.split("\n")[1:-1]]
    falling = {code: -1.0 - i for i, code in enumerate(codes)}
    row = status_of(spark, falling)
    assert (row.strongest, row.strongest_reason, row.weakest, row.weakest_reason) == (
        "000300.SH", "falls_least", "899050.BJ", "leads_broad_fall")
    row = status_of(spark, {code: 6.0 - i for i, code in enumerate(codes)})
    assert (row.strongest_reason, row.weakest_reason) == ("leads_broad_rise", "rises_least")
    # equal changes keep the order of the list: the first leads, the last lags
    row = status_of(spark, dict.fromkeys(codes, 0.0))
    assert (row.strongest, row.weakest) == ("000300.SH", "899050.BJ")


def test_turnarounds(spark):
    """The leader of the day had the worst four days, the laggard the best."""
    row = status_of(spark, {"000852.SH": 3.0, "399006.SZ": -3.0})
    assert (row.strongest_reason, row.weakest_reason) == ("recovers_today", "falls_back_today")


def test_only_three_risks_are_kept(spark):
    codes = [line.split()[0] for line in INDEXES.split("\n")[1:-1]]
    weak = dict.fromkeys(codes, -0.5) | {"899050.BJ": -3.0, "000688.SH": -2.0}
    down = {"煤炭": -1.0, "汽车": -1.2, "传媒": -3.0, "计算机": -4.0}
    row = status_of(spark, weak, down)
    # all indexes and four of the six shown sectors' changes fall; divergence and concentration would be next
    assert row.risks == ["general_weakness", "growth_pressure", "small_cap_pressure"]
    assert row.sector_summary == "mostly_down"


def test_three_kinds_of_unsafe_wording(spark):
    rows = spark.createDataFrame(
        [('{"summary": "可以买入", "local_path": "C:/secret", "raw_payload": 1}',), ("plain",), ("x" * 50000 + " Target PRICE",), (None,)],
        "text string",
    )
    got = [r.found for r in publishing.with_wording_violations(rows, F.col("text"), "found").collect()]
    assert got[0] == ["prohibited wording: 买入", "forbidden sensitive field: raw_payload", "forbidden local absolute path"]
    assert got[1] == [] and got[2] == ["prohibited wording: target price"] and got[3] == []


def analysis_run(spark):
    rows = [
        ("600519.SH", 0.1, 0.8, 0.89, True, "none"), ("300001.SZ", None, 0.2, 0.24, False, "low_liquidity"),
    ]
    names = ["mom_60", "ma_strength", "flow_5d", "flow_20d", "winner_rate", "vol_20", "max_drawdown_60", "avg_amount_20",
             "momentum_score", "flow_score", "chip_score", "liquidity_score"]
    return spark.createDataFrame(
        rows, "symbol string, mom_20 double, risk_score double, total_score double, tradable_flag boolean, exclusion_reason string"
    ).withColumns({n: F.lit(0.5) for n in names} | {
        "trade_date": F.lit(DAY), "name": F.lit("n"), "industry": F.lit("i"), "market_segment": F.lit("m")})


def test_security_analysis(spark):
    got = {r.symbol: r for r in research.analyze_stock(analysis_run(spark), ["600519.SH", "300001.SZ", "X"]).collect()}
    assert got["300001.SZ"].risk_notes == ["low_liquidity", "Recent volatility or drawdown score is weak."]
    assert got["600519.SH"].risk_notes == ["No blocking risk flag in the selected factor run."]
    assert [v.missing_data for v in got["300001.SZ"].factor_values][:2] == [True, False]
    assert len(got["600519.SH"].factor_values) == 15
    missing = got["X"]
    assert (missing.exclusion_reason, missing.total_score, missing.factor_values) == ("not_found_in_factor_run", None, [])
    assert missing.risk_notes == ["No current factor evidence is available for this symbol."]


def test_quotes_and_unchanged_bundles(spark):
    watch = spark.createDataFrame([("000300.SH",), ("nothing",)], "symbol string")
    quote = publishing.latest_quotes(watch, index_rows(spark)).collect()
    assert [(q.symbol, q.quote_date, q.change_percent) for q in quote] == [("000300.SH", DAY, 0.9)]
    bundles = spark.createDataFrame([("d1", "h1"), ("d2", "h2")], "trade_date string, bundle_hash string")
    sent = spark.createDataFrame([("d1", "h1"), ("d2", "other")], "trade_date string, bundle_hash string")
    assert [b.trade_date for b in publishing.unpublished(bundles, sent).collect()] == ["d2"]


def bundle_of(spark, **more):
    daily, classes = sector_rows(spark)
    return research.build_daily_bundle(analysis_run(spark).filter("tradable_flag"), index_rows(spark), daily, classes, **more)


def test_bundle_is_complete_and_fingerprinted(spark):
    bundle = bundle_of(spark).first()
    assert len(bundle.bundle_metadata.bundle_hash) == 64
    assert bundle.bundle_metadata.bundle_id == "daily_bundle_20250904_001"
    assert bundle.market_status.market_status_metadata.status == "complete"
    pool = bundle.candidate_pool
    assert [(s.rank, s.symbol, s.change_status) for s in pool.top_stocks] == [(1, "600519.SH", "newly_added")]
    assert (pool.candidate_pool_metadata.status, pool.diff.status) == ("no_previous_version", "no_previous_version")
    assert bundle_of(spark).first().bundle_metadata.bundle_hash == bundle.bundle_metadata.bundle_hash


def test_bundle_against_a_previous_pool(spark):
    previous = spark.createDataFrame([("600519.SH", 4), ("000001.SZ", 1)], "symbol string, rank int")
    bundle = bundle_of(spark, previous=previous, previous_version_id="pool_7", trade_date="2025-09-04").first()
    diff = bundle.candidate_pool.diff
    assert (diff.status, diff.previous_version_id, diff.upgraded, diff.removed) == ("compared", "pool_7", ["600519.SH"], ["000001.SZ"])
    assert bundle.candidate_pool.summary.removed == 1 and bundle.candidate_pool.top_stocks[0].previous_rank == 4


def test_bundle_errors(spark):
    bundle = bundle_of(spark)
    errors = lambda frame: publishing.with_bundle_errors(frame).first().errors
    assert errors(bundle) == []
    meta, market_status = F.col("bundle_metadata"), F.col("market_status")
    assert errors(bundle.withColumn("bundle_metadata", meta.withField("schema_version", F.lit("v0")))) == [
        "unsupported bundle schema_version", "bundle_hash mismatch"]
    assert errors(bundle.withColumn("market_status", market_status.withField("structural_risks", F.lit(None).cast("array<string>")))) == [
        "bundle_hash mismatch", "missing section: structural_risks"]
    spoken = bundle.withColumn("market_status", market_status.withField("structural_risks", F.array(F.lit("see C:/x, buy"))))
    assert errors(publishing.with_bundle_hash(spoken)) == ["prohibited wording: buy", "forbidden local absolute path"]


def test_bundles_are_written_by_date(spark, tmp_path):
    import json

    path = research.write_bundles(bundle_of(spark), str(tmp_path))
    (file,) = (tmp_path / "daily_bundles" / "day=20250904").glob("*.json")
    stored = json.loads(file.read_text())
    assert stored["candidate_pool"]["top_stocks"][0]["symbol"] == "600519.SH" and path.endswith("daily_bundles")
