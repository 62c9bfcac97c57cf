import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factorspark.operators import ranking


def rows_of(spark, values):
    return spark.createDataFrame(
        [(g, f"S{i:05d}", float(v)) for i, (g, v) in enumerate(values)], "g string, symbol string, value double"
    )


def skewed(seed=1, size=4000):
    """One group has most rows, and one value has a third of that group."""
    generator = np.random.default_rng(seed)
    groups = generator.choice(["hot", "b", "c"], size=size, p=[0.8, 0.15, 0.05])
    values = np.where(generator.random(size) < 0.35, 7.0, generator.normal(size=size).round(2))
    return list(zip(groups.tolist(), values.tolist()))


def by_pandas(values):
    frame = pd.DataFrame(values, columns=["g", "value"])
    frame["symbol"] = [f"S{i:05d}" for i in range(len(frame))]
    frame["avg"] = frame.groupby("g").value.rank(method="average")
    ordered = frame.sort_values(["g", "value", "symbol"])
    frame["ordinal"] = ordered.groupby("g").cumcount() + 1
    return frame.set_index("symbol")


@pytest.mark.parametrize("part_rows", [100, 250_000])
def test_ranks_of_a_hot_group_with_a_hot_value(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ranking, "PART_ROWS", part_rows)
    values = skewed()
    expected = by_pandas(values)
    frame = rows_of(spark, values)
    ordinal = ranking.ordinal_rank(frame, ["g"], "value", ["symbol"], "n").toPandas().set_index("symbol")
    assert (ordinal.n.sort_index() == expected.ordinal.sort_index()).all()
    average = ranking.long_average_rank(frame, ["g"], "value", ["symbol"]).toPandas().set_index("symbol")
    assert np.allclose(average.avg_rank.sort_index(), expected.avg.sort_index())
    assert (average.group_size.sort_index() == expected.groupby("g").value.transform("size").sort_index()).all()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([0.0, 1.0, -2.5, 3.25])), min_size=1, max_size=40))
def test_ranks_equal_pandas(spark, values):
    frame = rows_of(spark, values)
    got = ranking.long_average_rank(frame, ["g"], "value", ["symbol"]).orderBy("symbol").toPandas()
    assert got.avg_rank.tolist() == by_pandas(values).avg.sort_index().tolist()


def test_wide_ranks_agree_and_ignore_nulls(spark):
    generator = np.random.default_rng(5)
    rows = [
        (f"S{i}", "2026-01-0%d" % (1 + i % 2), None if i % 7 == 0 else float(generator.integers(0, 9)), float(i))
        for i in range(200)
    ]
    frame = spark.createDataFrame(rows, "symbol string, trade_date string, x double, y double")
    got = ranking.wide_average_ranks(frame, ["x", "y"]).orderBy("symbol").toPandas()
    pandas = pd.DataFrame(rows, columns=["symbol", "trade_date", "x", "y"]).sort_values("symbol").reset_index()
    for name in ("x", "y"):
        assert np.allclose(got[f"{name}__rank"].astype(float), pandas.groupby("trade_date")[name].rank(), equal_nan=True)
        assert (got[f"{name}__n"] == pandas.groupby("trade_date")[name].transform("count")).all()


def test_top_per_group_limits_before_the_shuffle(spark):
    frame = rows_of(spark, skewed(size=500))
    top = ranking.top_per_group(frame, ["g"], [F.col("value").desc(), F.col("symbol")], 3, "place")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {r["g"]: r["count"] for r in top.groupBy("g").count().collect()} == {"hot": 3, "b": 3, "c": 3}


def shared_files(spark):
    return sorted(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def odd_cross_section(spark):
    """Ties, nulls, a NaN, both zeros, a key that comes twice with two values, rows without key or date."""
    generator = np.random.default_rng(11)
    days = [None, "2026-01-01", "2026-01-02", "2026-01-05"]
    rows = [
        (None if i % 41 == 0 else f"S{i % 150}", days[generator.integers(0, 4)],
         None if i % 7 == 0 else float(generator.integers(-2, 9)), -0.0 if i % 5 == 0 else 0.0 if i % 3 == 0 else float("nan") if i % 11 == 0 else float(i))
        for i in range(400)
    ]
    return spark.createDataFrame(rows, "symbol string, trade_date string, x double, y double")


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_day_ranks_equal_the_ranks_of_crowded_days(spark, monkeypatch, batch):
    frame = odd_cross_section(spark)
    shown = lambda rows: sorted(map(repr, rows.select(*sorted(rows.columns)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        by_day = shown(ranking.wide_average_ranks(frame, ["x", "y"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(ranking, "DAY_ROWS", 99)
    assert 0 < len(ranking.crowded_days(frame)) < 3
    assert shown(ranking.wide_average_ranks(frame, ["x", "y"])) == by_day
    monkeypatch.setattr(ranking, "DAY_ROWS", 0)
    assert shown(ranking.wide_average_ranks(frame, ["x", "y"])) == by_day


def test_day_ranks_store_nothing_and_exchange_the_wide_rows_once(spark):
    frame = odd_cross_section(spark)
    before = shared_files(spark)
    ranked = ranking.wide_average_ranks(frame, ["x", "y"])
    assert ranked.count() == frame.filter("trade_date IS NOT NULL").count()
    assert shared_files(spark) == before
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
