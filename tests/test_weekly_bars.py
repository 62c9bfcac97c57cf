"""Bars of stocks, indexes and industries from a few shipments."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorspark.operators import indicators, ranking
from factorspark.sources.weekly_bars import MarketTables

LINES = ("l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
         " l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bars")
    lines = [
        (i % 7 if i % 11 else None, float(1 + i % 50), None if i % 13 == 5 else 100.25 + i * 1.37, (i % 5) / 100, (i % 3) / 100,
         "NRA"[i % 3], "O" if i % 4 else "F", None if i % 17 == 3 else datetime(2024, 1, 1) + timedelta(days=i % 40))
        for i in range(400)
    ]
    lines += lines[20:30]  # some come twice
    lines += [(9, 2.0, 10.0, 0.0, 0.0, "N", "O", datetime(2024, 1, 2)), (5, 3.0, None, 0.0, 0.0, "N", "O", datetime(2024, 5, 7))]
    # 2 comes twice, 3 has no nation, 9 is no supplier
    suppliers = [(0, 0), (1, 1), (2, 2), (2, 1), (3, None), (4, 1), (5, 0), (6, 2), (None, 1)]
    tables = {
        "lineitem": (lines, LINES),
        "supplier": ([(k, f"name {k}", n, 1.0) for k, n in suppliers], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "A", 0), (1, "B", 1), (2, "C", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "X"), (1, "Y")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return MarketTables(spark, str(folder))


def _by_bars(m, code):
    """The same roll-up from the bars of the suppliers."""
    sums = ["amount_", "volume_", "open_amount_", "open_volume_"]
    return (
        m.partial_bars.join(m.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(m.geography, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(code, "trade_date")
        .agg(*[F.sum(c).alias(c) for c in sums], F.max("high").alias("high"), F.min("low").alias("low"))
        .select(code, "trade_date", *m._bar_columns())
    )


def test_indexes_and_industries_do_not_send_a_row_per_bar(market):
    for rolled, code in ((market.index_bars, "r_regionkey"), (market.industry_daily, "n_nationkey")):
        columns = ["trade_date", "open", "high", "low", "close", "volume", "amount"]
        found = [tuple(r) for r in rolled.select(*columns).collect()]
        wanted = [tuple(r) for r in _by_bars(market, code).select(*columns).collect()]
        assert sorted(found, key=str) == sorted(wanted, key=str) and len(found) > 12
        assert "Aggregate [l_suppkey" not in rolled._jdf.queryExecution().optimizedPlan().toString()


def test_days_are_counted_by_bars_only_in_weeks_of_many_shipments(market, monkeypatch):
    from factorspark.verification import research_queries

    prices = market.prices
    for most in (4, 5, 6, 60):
        monkeypatch.setattr(ranking, "DAY_ROWS", most)
        fresh = MarketTables(market.spark, market.folder)
        assert sorted(research_queries.crowded(fresh)) == sorted(ranking.crowded_days(indicators.stocks_only(prices)))
    monkeypatch.setattr(ranking, "DAY_ROWS", 4)
    assert research_queries.crowded(MarketTables(market.spark, market.folder))
    monkeypatch.setattr(ranking, "DAY_ROWS", 1000)
    quiet = MarketTables(market.spark, market.folder)
    quiet.__dict__["prices"] = None  # not needed
    assert research_queries.crowded(quiet) == []
