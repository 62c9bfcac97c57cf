import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from factorspark.operators import catalog, coverage, date_masks, enforcement, merging, quality
from factorspark.operators.raw_mapping import map_raw, missing_expected_fields
from factorspark.plans import date_masks as mask_plans, promotion
from factorspark.plans.sync import plan_sync
from factorspark.sources import curated_tables, raw_batches
from factorspark.sources.schemas import RAW_TARGET, TABLES
from factorspark.streaming.incremental import promote_stream

DAILY = "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, vol double, amount double, pct_chg double"


def daily(spark, *rows):
    """(ts_code, trade_date, close)"""
    return spark.createDataFrame([(c, d, p, p, p, p, p, 10.0, 100.0, 0.5) for c, d, p in rows], DAILY)


# --- mapping ------------------------------------------------------------------

def test_market_segments_and_empty_dates(spark):
    rows = spark.createDataFrame(
        [("600519.SH", "600519", "A", "x", "i", "主板", "20010827", ""), ("688001.SH", "688001", "B", "x", "i", "科创板", "20190722", ""),
         ("300750.SZ", "300750", "C", "x", "i", "创业板", "20180611", ""), ("830799.BJ", "830799", "D", "x", "i", "北交所", "bad", ""),
         ("000001", "000001", "E", "x", "i", None, "19910403", "20200101")],
        "ts_code string, symbol string, name string, area string, industry string, market string, list_date string, delist_date string",
    )
    got = {r.symbol: r for r in map_raw(rows, "security_master").collect()}
    assert [got[s].market_segment for s in ("600519.SH", "688001.SH", "300750.SZ", "830799.BJ", "000001")] == [
        "sh_main", "star", "chinext", "bj", "unknown"]
    assert got["600519.SH"].market_segment_name == "上证主板" and got["000001"].market_segment_name == "未知"
    assert got["600519.SH"].list_date == date(2001, 8, 27) and got["600519.SH"].delist_date is None
    assert got["830799.BJ"].list_date is None and got["000001"].exchange is None
    assert got["000001"].delist_date == date(2020, 1, 1)


def test_absent_provider_columns_become_typed_nulls(spark):
    bare = spark.createDataFrame(
        [("000852.SH", "20260428", "1", "2", "0.5", "1.5")],
        "ts_code string, trade_date string, open string, high string, low string, close string",
    )
    row = map_raw(bare, "index_daily").first()
    assert (row.asset_type, row.close, row.volume, row.pct_change) == ("index", 1.5, None, None)
    industry = spark.createDataFrame(
        [("801080.SI", "电子", "20260428", 10.0, 1.2)], "ts_code string, name string, trade_date string, close double, pct_chg double"
    )
    assert map_raw(industry, "sw_daily").first().pct_change == 1.2
    classes = spark.createDataFrame([("801080.SI", "电子", "L1")], "index_code string, industry_name string, level string")
    assert map_raw(classes, "index_classify").first().source_system == "SW2021"


def test_chip_rows_mark_missing_results(spark):
    rows = spark.createDataFrame(
        [("A", "20260428", 81.0, "found"), ("B", "20260428", None, "not_found")],
        "ts_code string, trade_date string, winner_rate double, provider_status string",
    )
    assert [r.data_method for r in map_raw(rows, "cyq_perf").orderBy("symbol").collect()] == [
        "tushare_cyq_perf", "tushare_cyq_perf:not_found"]


def test_unknown_dataset_and_missing_fields(spark):
    with pytest.raises(ValueError):
        map_raw(spark.range(1), "nothing")
    assert missing_expected_fields(daily(spark), "daily") == []
    assert missing_expected_fields(spark.range(1), "adj_factor") == ["adj_factor", "trade_date", "ts_code"]
    assert set(RAW_TARGET.values()) <= set(TABLES)


# --- merging ------------------------------------------------------------------

def test_later_null_never_erases(spark):
    schema = "symbol string, trade_date string, a double, b string"
    old = spark.createDataFrame([("A", "d", 1.0, "x"), ("B", "d", 2.0, None)], schema)
    new = spark.createDataFrame([("A", "d", None, "y"), ("C", "d", 3.0, "z")], schema)
    got = {r.symbol: (r.a, r.b) for r in merging.coalescing_merge(old, new, ["symbol", "trade_date"]).collect()}
    assert got == {"A": (1.0, "y"), "B": (2.0, None), "C": (3.0, "z")}


def test_merge_adds_columns_and_respects_batch_order(spark):
    first = spark.createDataFrame([("A", 5.0, 0), ("A", 7.0, 1), ("A", None, 2)], "symbol string, flow double, batch int")
    chips = spark.createDataFrame([("A", 82.0, 3)], "symbol string, winners double, batch int")
    rows = first.unionByName(chips, allowMissingColumns=True)
    got = merging.coalescing_merge(None, rows, ["symbol"], ["batch"]).collect()
    assert [(r.symbol, r.flow, r.winners) for r in got] == [("A", 7.0, 82.0)]


def test_hot_key_merges_to_one_row(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("symbol"),
        F.col("id").cast("double").alias("v"), F.col("id").alias("batch"),
    )
    merged = merging.coalescing_merge(None, rows, ["symbol"], ["batch"])
    assert merged.filter("symbol = 'hot'").first().v == 19998.0
    assert merged.count() == rows.select("symbol").distinct().count()


def test_known_keys_compare_as_text(spark):
    current = spark.createDataFrame([("A", date(2026, 4, 28))], "symbol string, trade_date date")
    incoming = spark.createDataFrame([("A", "2026-04-28", 1.0), ("Z", "2026-04-28", 2.0)], "symbol string, trade_date string, f double")
    assert [r.symbol for r in merging.only_known_keys(incoming, current, ["symbol", "trade_date"]).collect()] == ["A"]
    assert merging.only_known_keys(incoming, None, ["symbol", "trade_date"]).count() == 0


def test_overlap_summary_counts(spark):
    old = spark.createDataFrame([("A",), ("B",)], "k string")
    new = spark.createDataFrame([("A",), ("A",), ("C",)], "k string")
    assert tuple(merging.overlap_summary(old, new, ["k"]).first()) == (3, 1, 1)
    assert tuple(merging.overlap_summary(None, new, ["k"]).first()) == (3, 1, 0)


def test_batch_id_union_and_version_status(spark):
    row = spark.range(1).select(merging.merged_batch_ids(
        F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("ids")).first()
    assert row.ids == ["a", "b", "c"]
    versions = spark.createDataFrame(
        [("v1", "d", "2026-04-27"), ("v2", "d", "2026-04-28")], "curated_version_id string, dataset_id string, created_at string"
    )
    got = {r.curated_version_id: r.status for r in merging.with_version_status(versions).collect()}
    assert got == {"v1": "inactive", "v2": "active"}


# --- promotion ------------------------------------------------------------------

def test_promotion_of_prices_supplements_and_suspensions(spark, workspace):
    def land(dataset, frame):
        return promotion.land_batch(workspace, "tushare", dataset, frame, "2026-04-28")

    land("daily_prices", daily(spark, ("600519.SH", "20260428", 1690.0)))
    promotion.promote_batch(workspace, "tushare", "daily_prices")
    land("adj_factor", spark.createDataFrame(
        [("600519.SH", "20260428", 7.5), ("999999.SZ", "20260428", 1.0)], "ts_code string, trade_date string, adj_factor double"))
    land("daily_basic", spark.createDataFrame([("600519.SH", "20260428", 0.3)], "ts_code string, trade_date string, turnover_rate double"))
    land("stk_limit", spark.createDataFrame([("600519.SH", "20260428", 1859.0, 1521.0)], "ts_code string, trade_date string, up_limit double, down_limit double"))
    land("suspend_d", spark.createDataFrame([("600519.SH", "20260428", "S")], "ts_code string, trade_date string, suspend_type string"))
    for dataset in ("adj_factor", "daily_basic", "stk_limit", "suspend_d"):
        promotion.promote_batch(workspace, "tushare", dataset)
    rows = workspace.current("daily_prices").collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.close, row.adj_factor, row.turnover_rate, row.limit_up, row.is_suspended) == (1690.0, 7.5, 0.3, 1859.0, True)
    assert (row.trade_year, row.trade_month, row.asset_type) == (2026, 4, "stock")
    event = workspace.current("risk_events").first()
    assert (event.event_type, event.severity, event.is_active, event.event_year) == ("suspension", "blocker", True, 2026)
    land("index_daily", daily(spark, ("000852.SH", "20260428", 6000.0)))
    promotion.promote_batch(workspace, "tushare", "index_daily")
    assert {r.asset_type for r in workspace.current("daily_prices").collect()} == {"stock", "index"}
    issues, report = promotion.check_quality(workspace)
    assert all(r.passed for r in report.collect())


def test_overlapping_batches_are_merged_and_noted(spark, workspace):
    for close in (1690.0, 1700.0):
        promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, ("600519.SH", "20260428", close)), "2026-04-28")
        result = promotion.promote_batch(workspace, "tushare", "daily_prices")
    assert result[0]["overlap_keys"] == 1
    rows = workspace.current("daily_prices").collect()
    assert [(r.close, r.source_batch_id) for r in rows] == [(1700.0, "tushare_daily_prices_20260428_002")]
    issues, report = promotion.check_quality(workspace)
    warnings = [(r.check_name, r.detail) for r in issues.filter("severity = 'warning'").collect()]
    assert warnings == [("overlapping_keys", 1)] and report.first().passed


def test_only_touched_partitions_are_replaced(spark, workspace):
    for day, close in (("20260331", 1.0), ("20260428", 2.0), ("20260428", 3.0)):
        promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, ("A.SH", day, close)), "2026-04-28")
        promotion.promote_batch(workspace, "tushare", "daily_prices")
    rows = {r.trade_date: r.close for r in workspace.current("daily_prices").collect()}
    assert rows == {date(2026, 3, 31): 1.0, date(2026, 4, 28): 3.0}
    versions = workspace.versions().orderBy("created_at").collect()
    assert [(v.row_count, v.status) for v in versions] == [(1, "inactive"), (2, "inactive"), (2, "active")]
    # the checksum kept up to date by differences equals the one of the whole table
    whole = curated_tables.fingerprint(enforcement.conform(workspace.current("daily_prices"), TABLES["daily_prices"]), "daily_prices")
    assert whole == (versions[-1].row_count, int(versions[-1].checksum))


def test_run_promotion_takes_all_batches(spark, workspace):
    ids = [
        promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, (c, "20260428", p)), "2026-04-28")
        for c, p in (("A.SH", 1.0), ("B.SH", 2.0), ("A.SH", 5.0))
    ]
    tasks = [("r", f"t{i}", "daily_prices", "20260428", i, "success", b) for i, b in enumerate(ids)]
    tasks += [("r", "t8", "daily_prices", "20260429", None, "failed", None), ("other", "t9", "daily_prices", "20260429", 0, "success", ids[0])]
    promotion.record_tasks(workspace, spark.createDataFrame(tasks, promotion.TASK_SCHEMA))
    promotion.promote_run(workspace, "r")
    got = {r.symbol: (r.close, r.source_batch_id) for r in workspace.current("daily_prices").collect()}
    assert got == {"A.SH": (5.0, ids[2]), "B.SH": (2.0, ids[1])}
    edges = workspace.metadata("version_batches").orderBy("position").collect()
    assert [e.batch_id for e in edges] == ids


def test_run_of_unknown_batches_is_refused(spark, workspace):
    batch = promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, ("A.SH", "20260428", 1.0)), "2026-04-28")
    tasks = [("r", "t1", "daily_prices", "20260428", 0, "success", batch), ("r", "t2", "daily_prices", "20260428", 1, "success", "nope_001")]
    promotion.record_tasks(workspace, spark.createDataFrame(tasks, promotion.TASK_SCHEMA))
    with pytest.raises(ValueError, match="nope_001"):
        promotion.promote_run(workspace, "r")
    with pytest.raises(ValueError, match="not found"):
        promotion.promote_run(workspace, "absent")
    assert workspace.current("daily_prices") is None


def test_run_takes_batches_of_different_columns(spark, workspace):
    wide = daily(spark, ("A.SH", "20260428", 1.0)).withColumn("extra", F.lit("x"))
    ids = [promotion.land_batch(workspace, "tushare", "daily_prices", frame, "2026-04-28") for frame in (
        wide.select(*reversed(wide.columns)), daily(spark, ("B.SH", "20260428", 2.0)))]
    tasks = [("r", f"t{i}", "daily_prices", "20260428", i, "success", b) for i, b in enumerate(ids)]
    promotion.record_tasks(workspace, spark.createDataFrame(tasks, promotion.TASK_SCHEMA))
    promotion.promote_run(workspace, "r")
    assert {r.symbol: r.close for r in workspace.current("daily_prices").collect()} == {"A.SH": 1.0, "B.SH": 2.0}


@pytest.mark.parametrize("broken", ["version_batches", "version_partitions", "curated_versions"])
def test_failed_promotion_can_be_run_again(spark, workspace, monkeypatch, broken):
    """Failure between the written folders and any of the records that follow them."""
    def land(day, close):
        return promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, ("A.SH", day, close)), "2026-04-28")

    land("20260331", 1.0)
    promotion.promote_batch(workspace, "tushare", "daily_prices")
    lost = land("20260428", 2.0)
    append = curated_tables.append_metadata

    def failing(rows, root, name):
        if name == broken:
            raise OSError("lost")
        append(rows, root, name)

    monkeypatch.setattr(curated_tables, "append_metadata", failing)
    with pytest.raises(OSError):
        promotion.promote_batch(workspace, "tushare", "daily_prices", batch_id=lost)
    monkeypatch.setattr(curated_tables, "append_metadata", append)
    assert [r.close for r in workspace.current("daily_prices").collect()] == [1.0]  # nothing of it is seen
    land("20260529", 3.0)
    promotion.promote_batch(workspace, "tushare", "daily_prices")
    promotion.promote_batch(workspace, "tushare", "daily_prices", batch_id=lost)
    active = workspace.versions().filter("status = 'active'").first()
    assert (active.row_count, int(active.checksum)) == curated_tables.fingerprint(
        enforcement.conform(workspace.current("daily_prices"), TABLES["daily_prices"]), "daily_prices")
    assert active.row_count == 3 and all(r.passed for r in promotion.check_quality(workspace)[1].collect())


def promoted(spark, workspace, *rows, dataset="daily_prices"):
    batch = promotion.land_batch(workspace, "tushare", dataset, daily(spark, *rows), "2026-04-28")
    promotion.promote_batch(workspace, "tushare", dataset, batch_id=batch)
    return batch


def test_snapshots_stay_as_they_were(spark, workspace):
    """Two promotions over the same month after a snapshot; then everything nobody lists is removed."""
    promoted(spark, workspace, ("A.SH", "20260427", 1.0), ("A.SH", "20260331", 0.5))
    snapshot = promotion.create_snapshot(workspace, "2026-04-28")
    promoted(spark, workspace, ("A.SH", "20260427", 2.0))
    promoted(spark, workspace, ("A.SH", "20260427", 3.0), ("B.SH", "20260427", 4.0))
    frozen = lambda: {(r.symbol, r.trade_date.month): r.close for r in curated_tables.read_snapshot(
        spark, workspace.root, snapshot, ["daily_prices"])["daily_prices"].collect()}
    now = lambda: {(r.symbol, r.trade_date.month): r.close for r in workspace.current("daily_prices").collect()}
    before = {("A.SH", 4): 1.0, ("A.SH", 3): 0.5}
    assert frozen() == before and now() == {("A.SH", 4): 3.0, ("B.SH", 4): 4.0, ("A.SH", 3): 0.5}
    removed = promotion.remove_unreferenced(workspace, "daily_prices")
    assert len(removed) == 1 and "trade_month=4" in removed[0]  # the second version's april
    assert frozen() == before and now() == {("A.SH", 4): 3.0, ("B.SH", 4): 4.0, ("A.SH", 3): 0.5}
    assert promotion.remove_unreferenced(workspace, "daily_prices") == []
    entry = curated_tables.snapshot_entries(workspace.metadata("snapshot_manifests"), snapshot, ["daily_prices"])["daily_prices"]
    rows = enforcement.conform(workspace.version("daily_prices", entry["curated_version_id"]), TABLES["daily_prices"])
    assert curated_tables.fingerprint(rows, "daily_prices") == (entry["row_count"], int(entry["checksum"]))


def test_a_snapshot_that_lost_a_folder_is_refused(spark, workspace):
    promoted(spark, workspace, ("A.SH", "20260427", 1.0), ("A.SH", "20260331", 0.5))
    snapshot = promotion.create_snapshot(workspace, "2026-04-28")
    listed = workspace.metadata("version_partitions").filter("partition = '2026/3'").collect()
    path = f"{workspace.root}/metadata/version_partitions"
    spark.createDataFrame(listed, curated_tables.VERSION_PARTITION).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="not the recorded ones"):
        curated_tables.read_snapshot(spark, workspace.root, snapshot, ["daily_prices"])


def test_lineage_grows_with_the_versions(spark, workspace, tmp_path):
    """Both batches lead to the snapshot made after the second; an import starts anew."""
    from factorspark.plans import browse

    first = promoted(spark, workspace, ("A.SH", "20260427", 1.0))
    second = promoted(spark, workspace, ("B.SH", "20260428", 2.0))
    snapshot = promotion.create_snapshot(workspace, "2026-04-28")
    seen = lambda batch: sorted((r.snapshot_id or "") for r in browse.inspect_run(workspace, batch).collect())
    assert seen(first) == ["", snapshot] and seen(second) == [snapshot]
    path = manual_csv(spark, tmp_path / "anew", [("C.SH", "2026-04-28", "stock")], "symbol string, trade_date string, asset_type string")
    promotion.import_csv(workspace, "daily_prices", path)
    later = promotion.create_snapshot(workspace, "2026-04-29")
    third = promoted(spark, workspace, ("D.SH", "20260428", 2.0))
    promoted(spark, workspace, ("D.SH", "20260428", 3.0))
    last = promotion.create_snapshot(workspace, "2026-04-30")
    assert seen(first) == ["", snapshot] and seen(second) == [snapshot] and later not in seen(third)
    assert seen(third) == ["", last]
    with pytest.raises(ValueError, match="not found"):
        browse.inspect_run(workspace, "nothing_001")


def test_two_streams_into_one_table(spark, workspace):
    """Prices and factors of the same month, promoted by two streams at once; each has to find its own scratch files."""
    days = [f"202604{d:02d}" for d in range(1, 3)]
    promoted(spark, workspace, *((s, d, 1.0) for d in days for s in ("A.SH", "B.SH")))
    for i, day in enumerate(days):
        promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, ("A.SH", day, 2.0 + i), ("C.SH", day, 5.0)), "2026-04-28")
        factors = spark.createDataFrame([(s, day, 7.0 + i) for s in ("A.SH", "B.SH")], "ts_code string, trade_date string, adj_factor double")
        promotion.land_batch(workspace, "tushare", "adj_factor", factors, "2026-04-28")
    streams = [promote_stream(workspace, d, f"{workspace.root}/checkpoint-{d}", "2026-04-28 16:00:00", 1) for d in ("daily_prices", "adj_factor")]
    for stream in streams:
        stream.awaitTermination()
    rows = {(r.symbol, r.trade_date.day): (r.close, r.adj_factor) for r in workspace.current("daily_prices").collect()}
    assert {k: v for k, v in rows.items() if k[0] != "C.SH"} == {
        (s, i + 1): (2.0 + i if s == "A.SH" else 1.0, 7.0 + i) for i in range(2) for s in ("A.SH", "B.SH")}
    assert {k[1] for k in rows if k[0] == "C.SH"} == {1, 2}
    chain = workspace.versions().orderBy("created_at").collect()
    assert [v.predecessor_id for v in chain] == [None, *(v.curated_version_id for v in chain[:-1])]


def test_locks_wait_and_are_taken_over(spark, workspace):
    from threading import Thread

    from factorspark.plans.locking import table_lock
    from factorspark.plans.runtime import filesystem

    order = []

    def hold(name):
        with table_lock(spark, workspace.root, "daily_prices"):
            order.append(("in", name))
            time.sleep(0.3)
            order.append(("out", name))

    threads = [Thread(target=hold, args=(i,)) for i in range(3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert [o[0] for o in order] == ["in", "out"] * 3 and all(a[1] == b[1] for a, b in zip(order[::2], order[1::2]))
    store, place = filesystem(spark, f"{workspace.root}/locks/daily_prices")
    store.createNewFile(place)  # left by a job that is gone
    with pytest.raises(TimeoutError):
        with table_lock(spark, workspace.root, "daily_prices", wait=0.5):
            pass
    store.setTimes(place, int((time.time() - 1000) * 1000), -1)
    with table_lock(spark, workspace.root, "daily_prices", wait=5):
        assert store.exists(place)
    assert not store.exists(place)


def test_scratch_belongs_to_its_thread(spark):
    """A opens, B opens, A ends: the files of B are still there."""
    from threading import Event, Thread

    from factorspark.plans.runtime import materialise, scratch

    opened, ended, counts = Event(), Event(), []

    def second():
        with scratch(spark):
            rows = materialise(spark.range(7), "second")
            opened.set()
            ended.wait(30)
            counts.append(rows.count())

    thread = Thread(target=second)
    with scratch(spark):
        thread.start()
        opened.wait(60)
    ended.set()
    thread.join()
    assert counts == [7]


def test_checksum_tells_repeats_and_nulls(spark):
    def checksum(*rows):
        frame = spark.createDataFrame(rows, "a string, b string")
        return frame.agg(raw_batches.content_checksum(["a", "b"])).first()[0]

    assert len({checksum(), checksum(("x", "y"), ("x", "y")), checksum(("x", None)), checksum((None, "x")), checksum(("x", "y"))}) == 5
    assert checksum(("x", "y"), (None, "z")) == checksum((None, "z"), ("x", "y"))


def land_as(spark, workspace, batch_id, *rows):
    """A batch under an id of its own, with its record."""
    frame = daily(spark, *rows)
    path = raw_batches.write_batch(frame, workspace.raw_root, "s", "daily_prices", "2026-04-28", batch_id)
    record = raw_batches.batch_record(frame, "s", "daily_prices", "2026-04-28", batch_id, path)
    curated_tables.append_metadata(record, workspace.root, "data_batches")


@pytest.mark.parametrize("per_trigger", [1, None])
def test_stream_follows_the_landing_order(spark, workspace, tmp_path, per_trigger):
    """The batch with the higher id landed first, so the other one wins, whatever a trigger takes."""
    records = ["b_002", "b_001"]
    for batch, close in zip(records, (2.0, 1.0)):
        land_as(spark, workspace, batch, ("A.SH", "20260428", close))
    for _ in range(2):
        promote_stream(workspace, "daily_prices", str(tmp_path / "checkpoint"), "2026-04-29 00:00:00", per_trigger).awaitTermination()
    rows = workspace.current("daily_prices").collect()
    assert [(r.close, r.source_batch_id) for r in rows] == [(1.0, "b_001")]
    assert {r.batch_id for r in workspace.metadata("version_batches").collect()} == set(records)
    assert workspace.versions().count() == (2 if per_trigger else 1)


def test_flow_and_chip_share_one_row(spark, workspace):
    promotion.land_batch(workspace, "tushare", "moneyflow_dc", spark.createDataFrame(
        [("A.SH", "20260428", 10.0, 1.5)], "ts_code string, trade_date string, net_amount double, net_amount_rate double"), "2026-04-28")
    promotion.promote_batch(workspace, "tushare", "moneyflow_dc")
    promotion.land_batch(workspace, "tushare", "cyq_perf", spark.createDataFrame(
        [("A.SH", "20260428", 88.0)], "ts_code string, trade_date string, winner_rate double"), "2026-04-28")
    promotion.promote_batch(workspace, "tushare", "cyq_perf")
    row = workspace.current("capital_flow_or_chip").first()
    assert (row.main_net_inflow_rate, row.close_profit_ratio, row.data_method) == (1.5, 88.0, "tushare_cyq_perf")


def test_missing_batch_and_duplicate_landing_fail(spark, workspace):
    with pytest.raises(ValueError):
        promotion.promote_batch(workspace, "tushare", "daily_prices")
    path = workspace.raw_root
    raw_batches.write_batch(daily(spark, ("A", "20260428", 1.0)), path, "s", "d", "2026-04-28", "b1")
    with pytest.raises(Exception):
        raw_batches.write_batch(daily(spark, ("A", "20260428", 1.0)), path, "s", "d", "2026-04-28", "b1")


def manual_csv(spark, path, rows, columns):
    spark.createDataFrame(rows, columns).coalesce(1).write.option("header", True).csv(str(path))
    return str(path)


def test_csv_import_snapshot_and_numbers(spark, workspace, tmp_path):
    path = manual_csv(spark, tmp_path / "c1", [("A.SH", "2026-04-28", "stock"), ("B.SH", "2026-04-28", "stock")],
                      "symbol string, trade_date string, asset_type string")
    rows = promotion.import_csv(workspace, "daily_prices", path, as_of_date="2026-04-28").collect()
    assert [(r.trade_year, r.trade_month, r.close, r.source) for r in rows] == [(2026, 4, None, "manual_csv")] * 2
    first = promotion.create_snapshot(workspace, "2026-04-28")
    second = promotion.create_snapshot(workspace, "2026-04-28")
    assert (first, second) == ("snapshot_20260428_001", "snapshot_20260428_002")
    manifests = workspace.metadata("snapshot_manifests")
    entries = catalog.inspect_snapshot(manifests.filter(F.col("snapshot_id") == second)).collect()
    assert [(e.dataset_id, e.details_row_count if hasattr(e, "details_row_count") else e.row_count) for e in entries] == [("daily_prices", 2)]
    with pytest.raises(ValueError):
        curated_tables.snapshot_entries(manifests, second, ["security_master"])
    with pytest.raises(ValueError):
        curated_tables.snapshot_entries(manifests, "snapshot_none", [])
    assert catalog.latest_snapshot(manifests).first().snapshot_id == second


def test_csv_import_rejects_missing_and_null_required(spark, workspace, tmp_path):
    path = manual_csv(spark, tmp_path / "c2", [("A.SH",)], "symbol string")
    with pytest.raises(ValueError, match="missing columns"):
        promotion.import_csv(workspace, "daily_prices", path)
    path = manual_csv(spark, tmp_path / "c3", [("A.SH", "not a date", "stock")], "symbol string, trade_date string, asset_type string")
    with pytest.raises(ValueError, match="contain nulls"):
        promotion.import_csv(workspace, "daily_prices", path)


def test_duplicate_keys_fail_quality_and_block_snapshots(spark, workspace, tmp_path):
    path = manual_csv(spark, tmp_path / "c4", [("A.SH", "2026-04-28", "stock")] * 2, "symbol string, trade_date string, asset_type string")
    promotion.import_csv(workspace, "daily_prices", path)
    issues, report = promotion.check_quality(workspace, ["daily_prices", "risk_events"])
    got = {(r.dataset_id, r.check_name) for r in issues.collect()}
    assert got == {("daily_prices", "duplicate_primary_keys"), ("risk_events", "current_version_missing")}
    assert not any(r.passed for r in report.collect())
    with pytest.raises(ValueError, match="snapshot refused"):
        promotion.create_snapshot(workspace, "2026-04-28")


def test_quality_of_a_broken_table(spark):
    rows = spark.createDataFrame([("A", None, "x"), ("A", None, "x")], "symbol string, trade_date date, extra string")
    table = TABLES["daily_prices"]
    found = {(r.check_name, r.column_name): r.detail for r in quality.table_issues(rows, table, 5).collect()}
    assert found[("row_count_mismatch", None)] == -3
    assert ("missing_column", "close") in found and ("extra_column", "extra") in found
    assert found[("nulls_in_required", "trade_date")] == 2
    assert found[("duplicate_primary_keys", "symbol,trade_date")] == 1
    empty = quality.table_issues(rows.limit(0), table).filter("check_name = 'empty'")
    assert empty.count() == 1


def test_field_catalogue(spark):
    rows = enforcement.field_catalogue(spark, TABLES)
    got = {r.dataset_id: (r.primary_symbol_field, r.primary_time_field) for r in rows.collect()}
    assert got["daily_prices"] == ("symbol", "trade_date") and got["risk_events"] == ("symbol", "event_date")
    assert got["industry_classification"] == (None, "created_at")


# --- stream -----------------------------------------------------------------------

def test_stream_promotes_each_batch_once(spark, workspace):
    def land(batch_id, *rows):
        land_as(spark, workspace, batch_id, *rows)

    def run():
        promote_stream(workspace, "daily_prices", workspace.root + "/checkpoint", "2026-04-28 16:00:00").awaitTermination()

    land("b1", ("A.SH", "20260427", 1.0), ("B.SH", "20260427", 2.0))
    run()
    land("b2", ("A.SH", "20260427", 9.0))
    land("b3", ("C.SH", "20260428", 3.0))
    run()
    versions = workspace.versions().count()
    run()
    assert workspace.versions().count() == versions
    got = {r.symbol: (r.close, r.source_batch_id) for r in workspace.current("daily_prices").collect()}
    assert got == {"A.SH": (9.0, "b2"), "B.SH": (2.0, "b1"), "C.SH": (3.0, "b3")}


# --- catalogue and coverage ---------------------------------------------------------

def test_preview_joins_names_and_checks_columns(spark):
    security = spark.createDataFrame([("600519.SH", "Kweichow Moutai")], "symbol string, name string")
    prices = spark.createDataFrame(
        [("600519.SH", date(2026, 4, 28), 1.2, 1690.0, 5.0), ("600519.SH", date(2026, 4, 27), 0.1, 1670.0, 5.0)],
        "symbol string, trade_date date, pct_change double, close double, amount double",
    )
    shown = catalog.preview(prices, "daily_prices", security, "600519.SH", "2026-04-28", "2026-04-28")
    assert shown.columns == ["symbol", "name", "trade_date", "pct_change", "close"]
    assert [tuple(r) for r in shown.collect()] == [("600519.SH", "Kweichow Moutai", date(2026, 4, 28), 1.2, 1690.0)]
    assert [r.trade_date.day for r in catalog.preview(prices, "daily_prices", security).collect()] == [28, 27]
    with pytest.raises(ValueError):
        catalog.preview(prices, "daily_prices", security, columns=["nothing"])
    with pytest.raises(ValueError):
        catalog.preview(prices, "daily_prices", limit=0)


def test_sync_plan_lists_missing_dates(spark):
    calendar = spark.createDataFrame(
        [("SSE", "20260429", "1", "20260428"), ("SSE", "20260430", "1", "20260429"), ("SSE", "20260501", "0", "20260430")],
        "exchange string, cal_date string, is_open string, pretrade_date string",
    )
    day = date(2026, 4, 28)
    tables = {
        "trading_calendar": spark.createDataFrame([(day, True)], "trade_date date, is_trading_day boolean"),
        "daily_prices": spark.createDataFrame(
            [("600519.SH", day, "stock", 1.0, 1.0, 1.0, False)],
            "symbol string, trade_date date, asset_type string, adj_factor double, turnover_rate double, limit_up double, is_suspended boolean"),
        "capital_flow_or_chip": spark.createDataFrame(
            [("600519.SH", day, 1.0, None, "tushare_cyq_perf")],
            "symbol string, trade_date date, main_net_inflow_rate double, main_net_inflow double, data_method string"),
    }
    missing = plan_sync(calendar, tables)
    got = {}
    for row in missing.orderBy("trade_date").collect():
        got.setdefault(row.dataset, []).append(row.trade_date.day)
    for dataset in ("daily_prices", "moneyflow_dc", "cyq_perf", "adj_factor", "daily_basic", "stk_limit", "suspend_d", "index_daily"):
        assert got[dataset] == [29, 30], dataset
    assert got["index_classify"] == [30] and got["sw_daily"] == [29, 30]
    with pytest.raises(ValueError):
        plan_sync(calendar, tables, ["nothing"])


def test_date_masks_equal_a_rescan(spark):
    """First and last days of months, nulls in every column, repeated rows, a symbol and a month without rows."""
    rows = [("A", "2026-01-01", 1.0), ("A", "2026-01-31", None), ("A", "2026-01-31", None), ("A", "2026-03-31", 2.0), ("B", "2026-01-31", 1.0),
            ("B", None, 1.0), (None, "2026-01-02", 1.0), ("X", "1969-12-31", 1.0)]
    prices = spark.createDataFrame([(s, d and date.fromisoformat(d), "stock", f) for s, d, f in rows] + [("I", date(2026, 1, 2), "index", 1.0)],
                                   "symbol string, trade_date date, asset_type string, adj_factor double")
    masks = date_masks.price_masks(prices)
    days = [date(2026, 1, 1), date(2026, 1, 31), date(2026, 2, 2), date(2026, 3, 31)]
    calendar = spark.createDataFrame([(d,) for d in [*days, days[0], None]], "trade_date date")
    symbols = spark.createDataFrame([("A",), ("B",), ("C",), ("C",), (None,)], "symbol string")
    again = date_masks.combined(masks, masks)  # parts may repeat
    got = date_masks.missing_by_symbol(calendar, ["daily_prices", "adj_factor"], symbols, again).collect()
    held = {("daily_prices", s, d) for s, d, _ in rows} | {("adj_factor", s, d) for s, d, f in rows if f is not None}
    wanted = [(n, s, d) for n in ("daily_prices", "adj_factor") for s in "ABC" for d in days if (n, s, d.isoformat()) not in held]
    assert sorted(map(tuple, got)) == sorted(wanted)
    late = date_masks.missing_by_symbol(calendar, ["adj_factor"], symbols, masks, "2026-01-31", "2026-02-28").collect()
    assert sorted(map(tuple, late)) == sorted(w for w in wanted if w[0] == "adj_factor" and date(2026, 1, 31) <= w[2] <= date(2026, 2, 28))
    rescan = {tuple(r) for r in coverage.price_coverage(prices.filter("symbol is not null")).collect()}
    assert {tuple(r) for r in date_masks.covered_dates(masks).collect()} == rescan
    assert date_masks.missing_by_symbol(calendar.limit(0), ["adj_factor"], symbols, masks).count() == 0
    assert date_masks.missing_by_symbol(calendar, ["adj_factor"], symbols, masks.limit(0)).count() == 3 * len(days)


def test_date_masks_follow_the_versions(spark, workspace):
    """Only folders that are new since the last time are read; older versions keep their masks."""
    held = lambda version=None: sorted(
        (r.symbol, r.trade_date.month, r.trade_date.day) for r in mask_plans.read(workspace, "daily_prices", version).filter("dataset = 'daily_prices'")
        .select("symbol", F.explode(date_masks._dates(F.col("days"))).alias("trade_date")).collect())
    assert held() == []
    promoted(spark, workspace, ("A.SH", "20260427", 1.0), ("A.SH", "20260331", 0.5))
    first = curated_tables.active_version(spark, workspace.root, "daily_prices")
    assert len(mask_plans.record(workspace, "daily_prices")) == 2 and mask_plans.record(workspace, "daily_prices") == []
    promoted(spark, workspace, ("B.SH", "20260428", 2.0))
    april = mask_plans.record(workspace, "daily_prices")
    assert len(april) == 1 and "trade_month=4" in april[0]
    assert held() == [("A.SH", 3, 31), ("A.SH", 4, 27), ("B.SH", 4, 28)]
    assert held(first) == [("A.SH", 3, 31), ("A.SH", 4, 27)]
    calendar = spark.createDataFrame([(date(2026, 4, 27),), (date(2026, 4, 28),)], "trade_date date")
    symbols = spark.createDataFrame([("A.SH",), ("B.SH",)], "symbol string")
    missing = mask_plans.missing_by_symbol(workspace, "daily_prices", calendar, ["daily_prices"], symbols).collect()
    assert sorted((r.symbol, r.trade_date.day) for r in missing) == [("A.SH", 28), ("B.SH", 27)]


def test_benchmarks_cover_a_date_only_together(spark):
    rows = spark.createDataFrame(
        [("a", date(2026, 4, 27), "index"), ("a", date(2026, 4, 28), "index"), ("b", date(2026, 4, 28), "index")],
        "symbol string, trade_date date, asset_type string",
    )
    assert [r.trade_date.day for r in coverage.benchmark_coverage(rows, ["a", "b"]).collect()] == [28]


def test_work_list_chunks(spark):
    days = spark.createDataFrame([(date(2026, 4, 28),)], "trade_date date")
    symbols = spark.createDataFrame([(str(i),) for i in range(5)], "symbol string")
    got = sorted((r.symbol_start, r.symbol_end) for r in coverage.work_list(["moneyflow_dc"], days, symbols, 2).collect())
    assert got == [(0, 2), (2, 4), (4, 5)]
    assert coverage.work_list(["moneyflow_dc"], days, symbols.limit(0), 2).count() == 0


def test_placeholder_rows_and_statistics(spark):
    requested = spark.createDataFrame([("A", "d"), ("B", "d")], "symbol string, day string")
    results = spark.createDataFrame([("A", "d", 80.0)], "symbol string, day string, winner_rate double")
    got = {r.symbol: (r.winner_rate, r.provider_status, r.provider_message) for r in coverage.with_not_found(results, requested, ["symbol", "day"]).collect()}
    assert got == {"A": (80.0, "found", None), "B": (None, "not_found", "empty_result")}
    tasks = spark.createDataFrame([("success", 5), ("failed", 0), ("pending", None)], "status string, row_count int")
    assert tuple(coverage.run_statistics(tasks).first()) == (3, 1, 1, 2, 5)


def test_error_classes(spark):
    rows = spark.createDataFrame(
        [("每分钟最多访问该接口200次, 没有权限",), ("抱歉，您没有权限",), ("Rate LIMIT",), ("boom",), (None,)], "message string")
    reason, retry = coverage.classify_error("message")
    got = [tuple(r) for r in rows.select(reason, retry).collect()]
    assert got == [("rate_limit", True), ("permission_denied", False), ("rate_limit", True), ("unknown", False), ("unknown", False)]


def test_latest_factor_run_of_the_family(spark):
    runs = spark.createDataFrame(
        [("r1", "flow_momentum_quality_v001", "2026-04-27", None), ("r2", "", None, "2026-04-28T10:00"), ("r3", "other", "2027-01-01", None)],
        "factor_run_id string, factor_version string, end_date string, created_at string",
    )
    assert catalog.latest_factor_run(runs).first().factor_run_id == "r2"


def test_browsing_a_promoted_batch(spark, workspace):
    from factorspark.plans import browse

    with pytest.raises(ValueError):
        browse.list_runs(workspace)
    batch = promotion.land_batch(workspace, "tushare", "daily_prices", daily(spark, ("A.SH", "20260428", 2.0)), "2026-04-28")
    promotion.promote_batch(workspace, "tushare", "daily_prices")
    snapshot = promotion.create_snapshot(workspace, "2026-04-28")
    runs = browse.list_runs(workspace).collect()
    assert [(r.batch_id, r.row_count, r.total_runs) for r in runs] == [(batch, 1, 1)] and runs[0].schema_hash.endswith("...")
    lineage = browse.inspect_run(workspace, batch).collect()
    assert [(r.batch_id, r.snapshot_id) for r in lineage] == [(batch, snapshot)]
    version = browse.inspect_curated(workspace, "daily_prices").first()
    assert version.matches and version.actual_row_count == 1
    assert browse.preview_curated(workspace, "daily_prices", columns=["symbol", "close"]).first().close == 2.0
    assert browse.inspect_snapshot(workspace, snapshot).first().dataset_id == "daily_prices"
    in_2025 = browse.preview_curated(workspace, "daily_prices", start="2025-01-01", end="2025-12-31")
    assert in_2025.count() == 0
    assert "trade_year" in in_2025._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert browse.preview_curated(workspace, "daily_prices", start="2026-01-01", end="2026-12-31").count() == 1
    with pytest.raises(ValueError):
        browse.preview_curated(workspace, "risk_events")
