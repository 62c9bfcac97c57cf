"""Snapshots, lineage and browsing.

Lineage is kept as edge rows (version, batch) and (snapshot, version) instead of id
lists inside one row, so a version fed by any number of batches stays distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.columns import short_hash

MANIFEST_SCHEMA = (
    "struct<curated_versions: map<string, struct<curated_version_id: string, schema_version_id: string, "
    "path: string, row_count: bigint, checksum: string, as_of_date: string>>>"
)


def next_number(ids: DataFrame, id_column: str, prefix_columns: list[str]) -> DataFrame:
    """Highest numeric suffix per prefix, plus one."""
    suffix = F.regexp_extract(id_column, r"_([0-9]+)$", 1).try_cast("bigint")
    return ids.groupBy(*prefix_columns).agg((F.coalesce(F.max(suffix), F.lit(0)) + 1).alias("next_number"))


def numbered_id(prefix, number):
    """prefix_001; the number widens past three digits."""
    text = number.cast("string")
    return F.concat(prefix, F.lit("_"), F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0")))


def snapshot_totals(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("status") == "active").agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_row_count"),
    )


def snapshot_manifest(versions: DataFrame) -> DataFrame:
    """One manifest row over the active versions: at most one per dataset."""
    details = F.struct("curated_version_id", "schema_version_id", "path", "row_count", "checksum", "as_of_date")
    entry = F.struct(F.col("dataset_id").alias("key"), details.alias("value"))
    body = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return versions.filter(F.col("status") == "active").agg(
        F.to_json(F.struct(body.alias("curated_versions"))).alias("manifest_json"),
        F.count(F.lit(1)).alias("dataset_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_row_count"),
    )


def inspect_snapshot(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot and dataset of its manifest."""
    parsed = F.from_json("manifest_json", MANIFEST_SCHEMA)
    return snapshots.select(
        *[c for c in snapshots.columns if c != "manifest_json"],
        F.explode(parsed["curated_versions"]).alias("dataset_id", "details_"),
    ).select(*[c for c in snapshots.columns if c != "manifest_json"], "dataset_id", "details_.*")


def list_runs(batches: DataFrame, newest: int) -> DataFrame:
    """The newest batches with the total count and shortened hashes."""
    total = batches.agg(F.count(F.lit(1)).alias("total_runs"))
    shown = batches.orderBy(F.col("retrieved_at").desc(), F.col("batch_id").desc()).limit(newest)
    if "schema_hash" in batches.columns:
        shown = shown.withColumn("schema_hash", short_hash("schema_hash"))
    return shown.withColumn("total_runs", total.scalar())


def version_chains(versions: DataFrame) -> DataFrame:
    """(curated_version_id, dataset_id, chain, place): versions of one chain grow out of each other, in order.

    A version without predecessor (the first one, an import) starts a chain. The window runs over the versions of a
    dataset, one row per promotion."""
    in_time = Window.partitionBy("dataset_id").orderBy("created_at", "curated_version_id")
    starts = F.when(F.col("predecessor_id").isNull(), 1).otherwise(0)
    return versions.select(
        "curated_version_id", "dataset_id", F.sum(starts).over(in_time).alias("chain"), F.row_number().over(in_time).alias("place"))


def cumulative_batches(version_batches: DataFrame, versions: DataFrame) -> DataFrame:
    """(batch_id, curated_version_id) of every version that contains a batch: the one it was merged into and all that grew out of it."""
    chains = version_chains(versions)
    first = (
        version_batches.select("batch_id", "curated_version_id").join(chains, "curated_version_id")
        .groupBy("batch_id", "dataset_id", "chain").agg(F.min("place").alias("first_")))
    return (
        chains.join(first, ["dataset_id", "chain"]).filter(F.col("place") >= F.col("first_"))
        .select("batch_id", "curated_version_id"))


def run_lineage(batches: DataFrame, version_batches: DataFrame, versions: DataFrame, snapshot_versions: DataFrame) -> DataFrame:
    """batch -> versions that contain it, later ones included -> snapshots that contain those versions."""
    wanted = version_batches.join(batches.select("batch_id"), "batch_id", "left_semi")
    return cumulative_batches(wanted, versions).join(
        snapshot_versions.select("curated_version_id", "snapshot_id"), "curated_version_id", "left")


def inspect_version(version: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded against actual row count and the column count of the current table."""
    counted = actual.agg(F.count(F.lit(1)).alias("actual_")).scalar()
    return (
        version.withColumn("actual_row_count", counted)
        .withColumn("column_count", F.lit(len(actual.columns)))
        .withColumn("matches", F.col("row_count") == F.col("actual_row_count"))
    )


# Columns shown by default
_PREVIEW = {
    "daily_prices": ["symbol", "name", "market_segment_name", "area", "industry", "trade_date", "pct_change", "close"],
    "security_master": ["symbol", "name", "exchange", "market", "market_segment_name", "market_segment", "area",
                        "industry", "list_date", "status"],
    "capital_flow_or_chip": ["symbol", "name", "trade_date", "main_net_inflow_rate", "close_profit_ratio"],
}
_SECURITY_ATTRIBUTES = ["name", "market_segment", "market_segment_name", "area", "industry"]
_DATE_COLUMNS = ["trade_date", "as_of_date", "event_date", "business_date"]


def preview(
    frame: DataFrame, dataset: str, security: DataFrame | None = None, symbol: str | None = None,
    start: str | None = None, end: str | None = None, columns: list[str] | None = None, limit: int = 20,
) -> DataFrame:
    """Newest rows first. Symbol and date filters reach the scan as partition or column filters."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    if symbol and "symbol" in frame.columns:
        frame = frame.filter(F.col("symbol") == symbol)
    day = next((c for c in _DATE_COLUMNS if c in frame.columns), None)
    if day and start:
        frame = frame.filter(F.col(day) >= F.lit(start).cast(dict(frame.dtypes)[day]))
    if day and end:
        frame = frame.filter(F.col(day) <= F.lit(end).cast(dict(frame.dtypes)[day]))
    # the year partitions follow from the date range, so whole folders are skipped
    for bound, keep in ((start, ">="), (end, "<=")):
        if bound and day and f"{day.split('_')[0]}_year" in frame.columns:
            frame = frame.filter(f"{day.split('_')[0]}_year {keep} {int(bound[:4])}")
    wanted = columns or _PREVIEW.get(dataset, frame.columns[:8])
    attributes = [c for c in _SECURITY_ATTRIBUTES if c in wanted and c not in frame.columns]
    if attributes and security is not None and "symbol" in frame.columns:
        attributes = [c for c in attributes if c in security.columns]
        frame = frame.join(security.select("symbol", *attributes), "symbol", "left")
    absent = [c for c in wanted if c not in frame.columns]
    if absent and columns:
        raise ValueError("missing columns: " + ", ".join(absent))
    order = [F.col(c).desc() if i == 0 else F.col(c).asc() for i, c in enumerate(
        [c for c in [day, "symbol"] if c and c in frame.columns])]
    shown = frame.orderBy(*order) if order else frame
    return shown.select(*[c for c in wanted if c in frame.columns]).limit(limit)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    newest = F.max(F.struct("created_at", "snapshot_id"))
    return snapshots.agg(newest["snapshot_id"].alias("snapshot_id"), newest["created_at"].alias("created_at"))


def latest_factor_run(runs: DataFrame) -> DataFrame:
    """Newest run (by end date, else creation) of the scored strategy family."""
    version = F.coalesce("factor_version", F.lit(""))
    family = version == ""
    for name in fv.FACTOR_RUN_FAMILIES:
        family = family | F.contains(version, F.lit(name))
    age = F.coalesce(F.col("end_date").cast("string"), F.col("created_at").cast("string"))
    newest = F.max(F.struct(age.alias("age_"), F.col("factor_run_id").alias("run_")))
    return runs.filter(family).agg(newest["run_"].alias("factor_run_id"), newest["age_"].alias("newest"))
