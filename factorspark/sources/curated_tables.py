"""Curated Parquet tables.

A version of a table is a list of folders, one per date partition, that are written once and
never changed. A promotion writes new folders for the partitions it touches and a new list;
the newest listed version is the current table, and snapshots keep reading the older ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.enforcement import conform, validate
from ..plans.runtime import filesystem
from .raw_batches import content_checksum
from .schemas import TABLES, CuratedTable


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/curated/{name}"


COMMIT = "commit_"
#: The folders of a version, relative to the table; they replace nothing and are never replaced.
VERSION_PARTITION = (
    "curated_version_id string, dataset_id string, partition string, folder string, row_count bigint, checksum string"
)
VERSION_RECORD = (
    "curated_version_id string, dataset_id string, schema_version_id string, version_type string, path string, as_of_date string, "
    "row_count bigint, checksum string, notes string, predecessor_id string, created_at timestamp"
)


def active_version(spark: SparkSession, root: str, name: str) -> str | None:
    """The id of the newest recorded version."""
    versions = read_metadata(spark, root, "curated_versions")
    if versions is None:
        return None
    newest = F.max(F.struct("created_at", "curated_version_id"))["curated_version_id"]
    return versions.filter(F.col("dataset_id") == name).agg(newest.alias("v")).first()["v"]


def version_partitions(spark: SparkSession, root: str, version_id: str) -> dict[str, dict]:
    """partition -> folder, rows and checksum (a month or so each)."""
    rows = read_metadata(spark, root, "version_partitions")
    if rows is None:
        return {}
    return {r["partition"]: r.asDict() for r in rows.filter(F.col("curated_version_id") == version_id).collect()}


def read_folders(spark: SparkSession, root: str, name: str, folders: list[str], *more: Column) -> DataFrame:
    """The rows of some folders of a table (and `more` columns of its files); their partitions prune."""
    base = table_path(root, name)
    rows = spark.read.option("basePath", base).parquet(*(f"{base}/{folder}" for folder in folders))
    return rows.select(*[c for c in TABLES[name].columns if c in rows.columns], *more)


def own_folder() -> Column:
    """The folder a row was read from, as versions list it."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"({COMMIT}=[^/]+(?:/[^/=]+=[^/]+)*)/[^/]+$", 1)


def own_file() -> Column:
    """The file a row was read from, relative to the table."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"({COMMIT}=[^/]+/.+)$", 1)


def read_version(spark: SparkSession, root: str, name: str, version_id: str) -> DataFrame:
    """The rows of one version, whatever was promoted since."""
    folders = sorted({p["folder"] for p in version_partitions(spark, root, version_id).values()})
    if folders:
        return read_folders(spark, root, name, folders)
    return spark.createDataFrame([], TABLES[name].schema)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The current version of the table, or None when it was never written."""
    version_id = active_version(spark, root, name)
    return None if version_id is None else read_version(spark, root, name, version_id)


def write_commit(frame: DataFrame, root: str, name: str, commit: str, seen: Observation, *measures: Column) -> None:
    """New folders for the rows; nobody sees them before a version lists them.

    Files are sorted by the table's key, so that parts of a month hold ranges of symbols. `measures` are taken by the tasks that write, of which Spark counts one for each part even if some run again."""
    table = TABLES[name]
    measured = _gathered(frame, table).observe(seen, *measures)
    laid_out = measured.select(*table.columns).sortWithinPartitions(*table.partitions, *table.key)
    _writer(laid_out, table).mode("errorifexists").parquet(f"{table_path(root, name)}/{COMMIT}={commit}")


def read_commit(spark: SparkSession, root: str, name: str, commit: str) -> DataFrame:
    folder = f"{COMMIT}={commit}"
    return spark.read.schema(TABLES[name].schema).parquet(f"{table_path(root, name)}/{folder}").select(*TABLES[name].columns)


def folder_of(name: str, commit: str, partition: str) -> str:
    """The folder of a partition (as `partition_of` writes it) of a commit."""
    values = partition.split("/") if TABLES[name].partitions else []
    return "/".join([f"{COMMIT}={commit}", *(f"{c}={v}" for c, v in zip(TABLES[name].partitions, values))])


def _gathered(frame: DataFrame, table: CuratedTable) -> DataFrame:
    """One partition's rows meet in few files; a month with most rows is split."""
    return frame.hint("rebalance", *table.partitions) if table.partitions else frame


def _writer(frame: DataFrame, table: CuratedTable):
    return frame.write.partitionBy(*table.partitions) if table.partitions else frame.write


def overwrite_table(frame: DataFrame, root: str, name: str) -> DataFrame:
    """Validate, project to the schema and replace the table."""
    table = TABLES[name]
    shaped = conform(frame, table)
    validate(shaped, table)
    _writer(_gathered(shaped, table), table).mode("overwrite").option("partitionOverwriteMode", "static").parquet(table_path(root, name))
    return frame.sparkSession.read.schema(table.schema).parquet(table_path(root, name)).select(*table.columns)


def partition_of(table: CuratedTable) -> Column:
    """The partition of a row as text; an unpartitioned table is one partition."""
    return F.concat_ws("/", *table.partitions) if table.partitions else F.lit("")


def partition_facts(frame: DataFrame, name: str, *more: Column) -> DataFrame:
    """Per partition: rows, order-free checksum, nulls in required columns (and `more` aggregates), in one pass."""
    table = TABLES[name]
    must = [c for c in table.columns if c in table.required]
    return frame.groupBy(partition_of(table).alias("partition")).agg(
        F.count(F.lit(1)).alias("row_count"), content_checksum(table.columns).alias("checksum"),
        F.array_compact(F.array(*[F.when(F.count_if(F.col(c).isNull()) > 0, F.lit(c)) for c in must])).alias("null_columns"),
        *more,
    )


def totals(facts: list) -> tuple[int, int]:
    """(rows, checksum) of all partitions together."""
    return sum(f["row_count"] for f in facts), sum(int(f["checksum"]) for f in facts)


def fingerprint(frame: DataFrame, name: str) -> tuple[int, int]:
    """(rows, checksum) of rows in the table's schema."""
    return totals(partition_facts(frame, name).collect())


def record_version(
    spark: SparkSession, root: str, name: str, version_id: str, as_of_date: str, partitions: dict[str, dict],
    predecessor: str | None, notes: str | None = None,
) -> None:
    """List the folders of a version, then name it: the second makes it the current one."""
    listed = [(version_id, name, p, f["folder"], f["row_count"], f["checksum"]) for p, f in sorted(partitions.items())]
    append_metadata(spark.createDataFrame(listed, VERSION_PARTITION), root, "version_partitions")
    rows, checksum = totals(list(partitions.values()))
    record = (version_id, name, f"{name}_v001", "current", table_path(root, name), as_of_date, rows, str(checksum), notes, predecessor, None)
    version = spark.createDataFrame([record], VERSION_RECORD).withColumn("created_at", F.current_timestamp())
    append_metadata(version, root, "curated_versions")


def append_metadata(rows: DataFrame, root: str, name: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/metadata/{name}")


def read_metadata(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A metadata table, or None when nothing of it was recorded."""
    path = f"{root.rstrip('/')}/metadata/{name}"
    store, place = filesystem(spark, path)
    return spark.read.parquet(path) if store.exists(place) else None


def snapshot_entries(snapshots: DataFrame, snapshot_id: str, required: list[str]) -> dict[str, dict]:
    """dataset -> version id, rows and checksum of one manifest (at most one entry per curated table)."""
    from ..operators.catalog import inspect_snapshot

    entries = inspect_snapshot(snapshots.filter(F.col("snapshot_id") == snapshot_id))
    found = {r["dataset_id"]: r.asDict() for r in entries.select("dataset_id", "curated_version_id", "row_count", "checksum").collect()}
    if not found:
        raise ValueError(f"snapshot not found: {snapshot_id}")
    absent = [name for name in required if name not in found]
    if absent:
        raise ValueError("missing snapshot datasets: " + ", ".join(absent))
    return found


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str, required: list[str]) -> dict[str, DataFrame]:
    """dataset -> rows as they were when the snapshot was made.

    The listed folders have to add up to the recorded rows and checksum; a manifest that lost a folder is an error."""
    out = {}
    for name, entry in snapshot_entries(read_metadata(spark, root, "snapshot_manifests"), snapshot_id, required).items():
        listed = version_partitions(spark, root, entry["curated_version_id"])
        if totals(list(listed.values())) != (entry["row_count"], int(entry["checksum"])):
            raise ValueError(f"snapshot {snapshot_id}: the folders of {name} are not the recorded ones")
        out[name] = read_version(spark, root, name, entry["curated_version_id"])
    return out


def count_only(spark: SparkSession, path: str) -> DataFrame:
    """Row count; the scan reads no column."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
