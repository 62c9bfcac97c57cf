"""What the plans over a factor run read and write, on small tables."""

from datetime import date, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from factorspark.functions.columns import growth, rolling
from factorspark.operators import indicators, trades
from factorspark.operators.ranking import top_per_group
from factorspark.verification import research_queries

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(20)]


def optimised(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def market(spark):
    names = ["A", "B", "C", "D", None]
    prices = [(s, d, 10.0 + 3 * i + (i + 1) * ((j * 7) % 5), 1.0, "stock" if i else None)
              for i, s in enumerate(names) for j, d in enumerate(DAYS)] + [("IDX", d, 5.0, 1.0, "index") for d in DAYS]
    prices += prices[40:43]  # some rows of C come twice
    run = [(s, d, None if s == "B" and j == 3 else ((i * 5 + j * 3) % 7) / 7, s != "D" if j % 4 else None)
           for i, s in enumerate(names) for j, d in enumerate(DAYS)] + [("A", None, 9.0, True)]
    return (
        spark.createDataFrame(prices, "symbol string, trade_date date, close double, adj_factor double, asset_type string"),
        spark.createDataFrame(run, "symbol string, trade_date date, total_score double, tradable_flag boolean"),
    )


def test_factor_trades_look_ahead_for_chosen_symbols_only(spark):
    prices, run = market(spark)
    for rebalance, top in (("daily", 1), ("daily", 3), ("weekly", 2)):
        made = trades.factor_trades(run, prices, rebalance, top)
        chosen = run.filter("tradable_flag").join(trades.rebalance_dates(run, rebalance), "trade_date", "left_semi")
        best = top_per_group(chosen, ["trade_date"], trades.score_order(), top, "place")
        wanted = best.join(trades.forward_returns(prices, trades.holding_days_of(rebalance)), ["symbol", "trade_date"], "left").filter(
            "forward_return IS NOT NULL")
        assert sorted(made.select(*wanted.columns).collect(), key=str) == sorted(wanted.collect(), key=str) != []
        plan = optimised(made)  # the histories are cut to the chosen symbols before their windows
        assert plan.index("lead(") < plan.rindex("LeftSemi")


def test_stored_run_has_the_columns_read_and_all_rows(spark, monkeypatch):
    _, run = market(spark)
    monkeypatch.setattr(research_queries, "factor_run", lambda m: run.withColumns({"name": F.lit("n"), "flow_5d": F.lit(1.0)}))
    stored = research_queries.stored_factors(None, ["name"])
    assert stored.columns == ["symbol", "trade_date", "tradable_flag", "name"]
    assert stored.count() == run.count()


def test_pairs_leave_index_prices_out(spark, monkeypatch):
    prices, run = market(spark)
    seen = {}
    monkeypatch.setattr(research_queries, "factor_run", lambda m: run)
    monkeypatch.setattr(research_queries.evaluation, "paired", lambda factors, prices, days, wide: seen.setdefault("prices", prices))
    research_queries.pairs(SimpleNamespace(prices=prices))
    assert seen["prices"].exceptAll(prices.filter("symbol IS NULL OR symbol <> 'IDX'")).isEmpty()
    assert seen["prices"].count() == prices.count() - len(DAYS)


def test_high_of_sixty_rows_from_three_of_twenty(spark):
    closes = lambda i: None if i % 41 == 5 else float("nan") if i == 150 else float((i * 37) % 101) - 20.0
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), closes(i + shift), 1.0) for s, n, shift in (("A", 240, 0), ("B", 61, 7), ("C", 59, 9), ("D", 3, 0))
            for i in range(n)]
    rows += [("E", date(2020, 1, 1) + timedelta(days=i), float(i % 13), 1.0) for i in range(130)]
    adjusted = spark.createDataFrame(rows, "symbol string, trade_date date, adj_close double, amount double")
    found = indicators.price_indicators(adjusted)
    wanted = found.withColumn("wanted", growth(F.col("adj_close"), rolling(F.max, F.col("adj_close"), 60)))
    assert wanted.filter(~F.col("max_drawdown_60").eqNullSafe(F.col("wanted"))).isEmpty()
    assert wanted.filter("wanted IS NOT NULL").count() > 60
    assert "-59" not in optimised(found)
