"""As-of join and medians by selection against plain Python."""

import statistics
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest

from factorspark.operators import portfolio
from factorspark.operators.asof import as_of
from factorspark.operators.selection import exact_median

START = date(2020, 1, 1)


def test_as_of_equals_a_plain_search(spark):
    """One symbol holds most rows; requests before, between and after them, some twice."""
    rng = np.random.default_rng(1)
    rows = [("A", START + timedelta(int(d)), float(i)) for i, d in enumerate(rng.choice(2000, 600, replace=False))]
    rows += [("B", START + timedelta(400), 1.0), ("B", START + timedelta(400), 2.0), ("B", START + timedelta(900), None), (None, START, 9.0), ("C", None, 9.0)]
    asked = [(s, START + timedelta(int(d)), i) for i, (s, d) in enumerate(zip(rng.choice(["A", "B", "C", "D"], 300), rng.integers(-50, 2100, 300)))]
    asked += [asked[0], (None, START, 1), ("A", None, 2), ("B", START + timedelta(400), 3)]
    requests = spark.createDataFrame(asked, "symbol string, as_of_date date, request_ int")
    held = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    got = Counter((r.symbol, r.as_of_date, r.request_, r.found and (r.found.trade_date, r.found.close)) for r in as_of(requests, held).collect())
    wanted = Counter()
    for symbol, day, number in asked:
        known = [(d, c is not None, c) for s, d, c in rows if s == symbol and None not in (s, d, day) and d <= day]
        found = max(known, default=None, key=lambda k: (k[0], k[1], k[2] or 0))
        wanted[(symbol, day, number, found and (found[0], found[2]))] += 1
    assert got == wanted
    assert as_of(requests, held.limit(0)).where("found IS NOT NULL").count() == 0
    assert as_of(requests.limit(0), held).count() == 0


@pytest.mark.parametrize("parts, most_rows", [(256, 1_000_000), (4, 10), (2, 1)])
def test_medians_equal_plain_ones(spark, parts, most_rows):
    rng = np.random.default_rng(2)
    rows = [("even", float(x)) for x in rng.normal(size=100)] + [("odd", float(x)) for x in rng.normal(size=101)]
    rows += [("same", 1.5)] * 80 + [("most", 2.0)] * 90 + [("most", float(x)) for x in rng.normal(size=61)]
    rows += [("one", 7.0), ("none", None), (None, 1.0), (None, 4.0), ("two", -1.0), ("two", 5.0), ("edge", 1e300), ("edge", -1e300), ("edge", 0.0)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in exact_median(table, "v", ["g"], parts, most_rows).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in values.items()}
    whole = [v for _, v in rows if v is not None]
    assert exact_median(table, "v", (), parts, most_rows).first()["median"] == pytest.approx(statistics.median(whole))
    assert exact_median(table.limit(0), "v", ["g"], parts, most_rows).count() == 0


def test_trade_metrics_do_not_depend_on_the_way_to_the_median(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), START + timedelta(int(d)), float(x)) for s, d, x in zip(rng.integers(0, 3, 400), rng.integers(0, 40, 400), rng.normal(size=400))]
    trades = spark.createDataFrame([*rows, (None, START, 1.0), (2, START, None)], "setting int, trade_date date, forward_return double")
    for group in (["setting"], []):
        ways = [{str(r[0]) if group else "": r.asDict() for r in portfolio.trade_metrics(trades, group, most).collect()} for most in (1_000_000, 7)]
        assert ways[0].keys() == ways[1].keys()
        for key, measures in ways[0].items():
            assert ways[1][key] == {n: pytest.approx(v) for n, v in measures.items()}
