from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.operators import symbol_files
from factorspark.plans import browse, promotion, research, symbol_files as plans
from factorspark.sources import curated_tables

DAILY = "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, vol double, amount double, pct_chg double"


def promoted(spark, ws, *rows):
    """(ts_code, trade_date, close)"""
    frame = spark.createDataFrame([(c, d, p, p, p, p, p, 10.0, 100.0, 0.5) for c, d, p in rows], DAILY)
    batch = promotion.land_batch(ws, "provider", "daily_prices", frame, "2026-04-28")
    promotion.promote_batch(ws, "provider", "daily_prices", batch_id=batch)


@pytest.fixture
def small_files(spark):
    """Four rows a file."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "4")
    yield
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_entries_never_leave_a_symbol_out(spark):
    """Against the rows themselves; symbols that files lack are hardly ever taken for held."""
    generator = np.random.default_rng(5)
    names = ["", "é", "中", *(f"{n:06d}.SH" for n in range(400))]
    held = {(f"f{n}", names[i]) for n in range(8) for i in generator.integers(0, len(names), 60)}
    # repeated rows, a null symbol, and a file that holds nothing but null symbols
    rows = [("x", f, s) for f, s in held] * 2 + [("x", "f0", None), ("x", "none", None)]
    entries = symbol_files.file_entries(spark.createDataFrame(rows, "folder string, file string, symbol string").repartition(5))
    assert entries.columns == symbol_files.ENTRY
    asked = names[:12]
    checks = [symbol_files.can_hold([name]).alias(f"s{i}") for i, name in enumerate(asked)]
    got = entries.select("file", *checks, symbol_files.can_hold(asked).alias("any"), symbol_files.can_hold([]).alias("none")).collect()
    assert sorted(r.file for r in got) == [f"f{n}" for n in range(8)]
    found = {(r.file, name) for r in got for i, name in enumerate(asked) if r[f"s{i}"]}
    really = {(f, s) for f, s in held if s in asked}
    assert really <= found and len(found - really) <= 2
    assert all(r["any"] == any(f == r.file for f, _ in found) and not r["none"] for r in got)


def test_a_symbol_opens_only_files_that_can_hold_it(spark, workspace, small_files):
    promoted(spark, workspace, *[(f"{s:06d}.SH", f"202604{d}", float(s)) for s in range(20) for d in (27, 28)])
    whole = workspace.current("daily_prices")
    assert len(whole.inputFiles()) == 10
    before = plans.rows_of(workspace, "daily_prices", ["000007.SH"])
    assert len(before.inputFiles()) == 10  # nothing recorded yet: all is opened
    assert len(plans.record(workspace, "daily_prices")) == 1 and plans.record(workspace, "daily_prices") == []
    after = plans.rows_of(workspace, "daily_prices", ["000007.SH", None, "000007.SH"])
    assert len(after.inputFiles()) == 1  # a file holds two symbols
    expected = sorted(whole.filter("symbol = '000007.SH'").collect())
    assert len(expected) == 2 and sorted(before.collect()) == sorted(after.collect()) == expected
    assert plans.rows_of(workspace, "daily_prices", ["none"]).count() == 0
    assert plans.rows_of(workspace, "daily_prices", []).columns == whole.columns


def test_folders_without_entries_are_read_whole_and_old_entries_do_not_count(spark, workspace, small_files):
    rows = [(f"{s:06d}.SH", f"2026{m}27", float(s)) for s in range(8) for m in ("03", "04")]
    promoted(spark, workspace, *rows)
    plans.record(workspace, "daily_prices")
    first = curated_tables.active_version(spark, workspace.root, "daily_prices")
    promoted(spark, workspace, ("000001.SH", "20260427", 9.0), ("000009.SH", "20260428", 9.0))  # April is written anew
    for recorded in (False, True):
        if recorded:
            assert len(plans.record(workspace, "daily_prices")) == 1
        for symbol in ("000001.SH", "000009.SH", "000005.SH"):
            got = plans.rows_of(workspace, "daily_prices", [symbol])
            assert sorted(got.collect()) == sorted(workspace.current("daily_prices").filter(F.col("symbol") == symbol).collect())
    old = plans.rows_of(workspace, "daily_prices", ["000001.SH"], first)
    assert sorted((r.trade_date, r.close) for r in old.collect()) == [(date(2026, 3, 27), 1.0), (date(2026, 4, 27), 1.0)]
    assert promotion.remove_unreferenced(workspace, "daily_prices")  # entries of removed folders name no file to open
    assert plans.rows_of(workspace, "daily_prices", ["000001.SH"]).count() == 2


def test_previews_and_quotes_read_through_the_entries(spark, workspace, small_files):
    with pytest.raises(ValueError, match="no current curated version"):
        browse.preview_curated(workspace, "daily_prices", symbol="000003.SH")
    promoted(spark, workspace, *[(f"{s:06d}.SH", f"202604{d}", s + d / 100) for s in range(12) for d in (27, 28)])
    plain = browse.preview_curated(workspace, "daily_prices", symbol="000003.SH").collect()
    quotes = sorted(research.refresh_quotes(workspace, ["000003.SH", "000011.SH", "none"]).collect())
    plans.record(workspace, "daily_prices")
    shown = browse.preview_curated(workspace, "daily_prices", symbol="000003.SH")
    assert shown.collect() == plain and len(plain) == 2 and len(shown.inputFiles()) == 1
    assert sorted(research.refresh_quotes(workspace, ["000003.SH", "000011.SH", "none"]).collect()) == quotes
    assert [r.symbol for r in quotes] == ["000003.SH", "000011.SH"]
    assert research.refresh_quotes(workspace, []).count() == 0
