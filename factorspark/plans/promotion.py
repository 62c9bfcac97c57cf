"""Jobs that move landed batches into curated tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ..operators.catalog import inspect_snapshot, next_number, snapshot_manifest
from ..operators.enforcement import add_lineage, conform, missing_required
from ..operators.merging import coalescing_merge, only_known_keys, overlap_of, with_version_status
from ..operators.quality import promotion_warnings, report, table_issues
from ..operators.raw_mapping import map_raw, suspension_events
from ..sources import curated_tables as curated
from ..sources import raw_batches as raw
from ..sources.schemas import RAW_TARGET, SUPPLEMENTAL, TABLES
from .locking import table_lock
from .runtime import filesystem, materialise, remove, scratch


@dataclass(frozen=True)
class Workspace:
    """Folders of one installation; both have to be visible to every executor."""

    spark: SparkSession
    root: str

    @property
    def raw_root(self) -> str:
        return f"{self.root.rstrip('/')}/raw"

    def current(self, name: str) -> DataFrame | None:
        return curated.read_table(self.spark, self.root, name)

    def metadata(self, name: str) -> DataFrame | None:
        return curated.read_metadata(self.spark, self.root, name)

    def versions(self) -> DataFrame | None:
        rows = self.metadata("curated_versions")
        return None if rows is None else with_version_status(rows)

    def version(self, name: str, version_id: str) -> DataFrame:
        return curated.read_version(self.spark, self.root, name, version_id)


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def land_batch(ws: Workspace, source: str, dataset: str, frame: DataFrame, as_of_date: str) -> str:
    """Write one raw batch under the next id of its source, dataset and date."""
    prefix = f"{source}_{dataset}_{as_of_date.replace('-', '')}"
    known = ws.metadata("data_batches")
    number = 1
    if known is not None:
        same = known.filter(F.startswith("batch_id", F.lit(prefix + "_"))).withColumn("prefix", F.lit(prefix))
        row = next_number(same, "batch_id", ["prefix"]).first()
        number = row["next_number"] if row else 1
    batch_id = f"{prefix}_{number:03d}"
    path = raw.write_batch(frame, ws.raw_root, source, dataset, as_of_date, batch_id)
    landed = raw.read_file(ws.spark, path, frame.columns)  # what lies there now, not the frame again
    curated.append_metadata(
        raw.batch_record(landed, source, dataset, as_of_date, batch_id, path), ws.root, "data_batches"
    )
    return batch_id


def merge_into_current(
    ws: Workspace, name: str, incoming: DataFrame, order: list[str], batches: DataFrame, as_of_date: str, noted: dict,
    known_only: bool = False,
) -> dict:
    """Coalescing merge into the current table, writing only partitions with new rows.

    One writer at a time: the table's lock is held from reading the current version to naming
    the next. The merged partitions go into new folders; overlap and nulls are observed while
    they are written, rows and checksum come from one pass over them. Nothing that a reader or
    a snapshot sees is changed, and a promotion that failed anywhere leaves no version and can
    be run again. `batches` (batch_id, position) are recorded as lineage. With `known_only`,
    rows whose key the table lacks are left out.
    """
    table = TABLES[name]
    key, parts = list(table.key), list(table.partitions)
    with table_lock(ws.spark, ws.root, name), scratch(ws.spark):
        predecessor = curated.active_version(ws.spark, ws.root, name)
        listed = curated.version_partitions(ws.spark, ws.root, predecessor) if predecessor else {}
        current = ws.version(name, predecessor) if predecessor else None
        if known_only:
            incoming = only_known_keys(incoming, current, key)
        # the batch is parsed once: its partitions and its rows are read below
        shaped = materialise(declared_columns(incoming, name), f"incoming-{name}")
        touched = current
        if current is not None and parts:
            touched = current.join(shaped.select(*parts).distinct(), parts, "left_semi")
        merged = coalescing_merge(touched, shaped, key, order, counted=True)
        absent = missing_required(merged, table)
        if absent:
            raise ValueError("missing columns: " + ", ".join(absent))
        commit = uuid.uuid4().hex
        overlap = _write_counted(ws, name, conform(merged, table, keep=["in_", "had_"]), commit)
        facts = curated.partition_facts(curated.read_commit(ws.spark, ws.root, name, commit), name).collect()
        fresh = {
            f["partition"]: {"folder": curated.folder_of(name, commit, f["partition"]), "row_count": f["row_count"], "checksum": f["checksum"]}
            for f in facts
        }
        version_id = f"{name}_{uuid.uuid4().hex[:12]}"
        edges = batches.select(
            F.lit(version_id).alias("curated_version_id"), F.lit(name).alias("dataset_id"), "batch_id", F.col("position").cast("int"),
        )
        curated.append_metadata(edges, ws.root, "version_batches")
        notes = json.dumps({**noted, "last_promote_overlap": overlap}, sort_keys=True)
        partitions = {**listed, **fresh} if parts else fresh
        curated.record_version(ws.spark, ws.root, name, version_id, as_of_date, partitions, predecessor, notes)
    return {"dataset_id": name, "curated_version_id": version_id, **overlap}


def _write_counted(ws: Workspace, name: str, rows: DataFrame, commit: str) -> dict:
    """Write the rows as new folders, counting their overlap on the way; refused, and removed, if a required column has nulls."""
    must = [c for c in TABLES[name].columns if c in TABLES[name].required]
    seen = Observation(f"{name}-{commit}")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in must]
    curated.write_commit(rows, ws.root, name, commit, seen, *overlap_of(), *nulls)
    found = seen.get
    offending = sorted(c for c in must if found[f"null_{c}"])
    if offending:
        remove(ws.spark, f"{curated.table_path(ws.root, name)}/{curated.COMMIT}={commit}")
        raise ValueError("non-nullable columns contain nulls: " + ", ".join(offending))
    return {c: found[c] or 0 for c in ("incoming_rows", "incoming_duplicate_keys", "overlap_keys")}


def remove_unreferenced(ws: Workspace, name: str) -> list[str]:
    """Delete the folders that neither the current version nor a snapshot lists; returns them."""
    with table_lock(ws.spark, ws.root, name):
        active = curated.active_version(ws.spark, ws.root, name)
        if active is None:
            return []
        listed = ws.metadata("version_partitions").filter(F.col("dataset_id") == name)
        kept = ws.spark.createDataFrame([(active,)], "curated_version_id string")
        snapshots = ws.metadata("snapshot_manifests")
        if snapshots is not None:
            kept = kept.unionByName(inspect_snapshot(snapshots).select("curated_version_id")).distinct()
        used = {r["folder"] for r in listed.join(kept, "curated_version_id", "left_semi").select("folder").distinct().collect()}
        base = curated.table_path(ws.root, name)
        depth = len(TABLES[name].partitions)
        store, place = filesystem(ws.spark, f"{base}/{curated.COMMIT}=*" + "/*=*" * depth)
        prefix = store.makeQualified(ws.spark._jvm.org.apache.hadoop.fs.Path(base)).toString() + "/"
        found = [status.getPath().toString().removeprefix(prefix) for status in store.globStatus(place) or []]
        unused = sorted(folder for folder in found if folder not in used)
        for folder in unused:
            remove(ws.spark, f"{base}/{folder}")
    return unused


def declared_columns(frame: DataFrame, name: str) -> DataFrame:
    """Columns of the schema and the ordering of the batches; what a batch lacks is left to the merge."""
    table = TABLES[name]
    return frame.select(*[c for c in frame.columns if c in table.columns or c.endswith("_order")])


def _batch(ws: Workspace, source: str, dataset: str, as_of_date: str | None, batch_id: str | None):
    known = ws.metadata("data_batches")
    if known is None:
        raise ValueError(f"raw batch not found: {source}/{dataset}")
    rows = known.filter(
        (F.col("source") == source) & (F.col("dataset_name") == dataset) & (F.col("status") == "success")
    )
    if as_of_date:
        rows = rows.filter(F.col("business_date") == as_of_date)
    if batch_id:
        rows = rows.filter(F.col("batch_id") == batch_id)
    found = rows.orderBy(F.col("retrieved_at").desc(), F.col("batch_id").desc()).limit(1).first()
    if found is None:
        raise ValueError(f"raw batch not found: {batch_id or f'{source}/{dataset}/{as_of_date or chr(42)}'}")
    return found


def promote_batch(
    ws: Workspace, source: str, dataset: str, as_of_date: str | None = None, batch_id: str | None = None
) -> list[dict]:
    """Map one landed batch and merge it. Suspensions update prices and risk events."""
    batch = _batch(ws, source, dataset, as_of_date, batch_id)
    one = ws.metadata("data_batches").filter(F.col("batch_id") == batch["batch_id"]).withColumn("position", F.lit(0))
    noted = {"last_promoted_batch_id": batch["batch_id"], "last_promoted_raw_dataset": dataset}
    return promote_recorded(ws, dataset, one, batch["business_date"], noted)


def promote_recorded(ws: Workspace, dataset: str, batches: DataFrame, day: str, noted: dict, stamp: str | None = None) -> list[dict]:
    """Map and merge recorded batches of one dataset in one pass; a later `position` wins over an earlier one."""
    if dataset not in RAW_TARGET:
        raise ValueError(f"no curated mapping for raw dataset: {dataset}")
    stamp = stamp or _now()
    landed = raw.read_recorded(ws.spark, ws.raw_root, batches)
    carried = ["source", "batch_id", "position"]

    def merge(mapped: list[DataFrame], name: str, known_only: bool = False) -> dict:
        rows = raw.stack_batches(mapped).withColumnsRenamed({"batch_id": "source_batch_id", "position": "position_order"})
        ready = add_lineage(rows, TABLES[name], "", "", day, stamp)
        return merge_into_current(ws, name, ready, ["position_order"], batches.select("batch_id", "position"), day, noted, known_only)

    name = RAW_TARGET[dataset]
    mapped = [map_raw(rows, dataset, carried) for rows in landed]
    if dataset == "suspend_d":
        results = [merge([suspension_events(rows, carried) for rows in landed], "risk_events")]
        return results if ws.current(name) is None else [merge(mapped, name, known_only=True), *results]
    return [merge(mapped, name, known_only=dataset in SUPPLEMENTAL)]


#: Tasks of a provider run: each fetched one batch.
TASK_SCHEMA = (
    "run_id string, task_id string, dataset_name string, trade_date string, symbol_start_offset bigint, status string, batch_id string"
)


def record_tasks(ws: Workspace, tasks: DataFrame) -> None:
    """Note what a run's tasks did; columns as in TASK_SCHEMA."""
    names = [c.split()[0] for c in TASK_SCHEMA.split(", ")]
    curated.append_metadata(tasks.select(*names).to(ws.spark.createDataFrame([], TASK_SCHEMA).schema), ws.root, "run_tasks")


def run_batches(ws: Workspace, run_id: str, dataset: str | None = None) -> DataFrame:
    """Successful batches of a run's successful tasks with their position per dataset: by date, offset, batch id.

    A task that names a batch without a record is an error."""
    tasks, known = ws.metadata("run_tasks"), ws.metadata("data_batches")
    if tasks is None or known is None:
        raise ValueError(f"raw run batches not found: {run_id}")
    done = tasks.filter((F.col("run_id") == run_id) & (F.col("status") == "success") & F.col("batch_id").isNotNull())
    if dataset:
        done = done.filter(F.col("dataset_name") == dataset)
    lost = done.join(known, "batch_id", "left_anti").select("batch_id").distinct().orderBy("batch_id").collect()
    if lost:
        raise ValueError("run names batches without a record: " + ", ".join(r["batch_id"] for r in lost))
    place = F.min(F.struct(
        F.coalesce("trade_date", F.lit("")).alias("trade_date"), F.coalesce("symbol_start_offset", F.lit(-1)).alias("offset"), "batch_id",
    )).alias("place_")
    ordered = Window.partitionBy("dataset_name").orderBy("place_")  # rows of one run's batches of a dataset
    batches = known.filter(F.col("status") == "success").join(done.groupBy("batch_id").agg(place), "batch_id")
    return batches.withColumn("position", F.row_number().over(ordered) - 1).drop("place_")


def promote_run(ws: Workspace, run_id: str, dataset: str | None = None) -> list[dict]:
    """All batches of a run, one merge per dataset whatever the number of batches."""
    with scratch(ws.spark):
        batches = materialise(run_batches(ws, run_id, dataset), "run-batches")
        per_dataset = batches.groupBy("dataset_name").agg(
            F.max_by("business_date", "position").alias("day"), F.count(F.lit(1)).alias("batches")
        ).orderBy("dataset_name").collect()
        if not per_dataset:
            raise ValueError(f"raw run batches not found: {run_id}/{dataset or 'all'}")
        results = []
        for row in per_dataset:
            noted = {
                "last_promoted_run_id": run_id, "last_promoted_raw_dataset": row["dataset_name"],
                "last_promoted_batch_count": row["batches"],
            }
            mine = batches.filter(F.col("dataset_name") == row["dataset_name"])
            results += promote_recorded(ws, row["dataset_name"], mine, row["day"], noted)
    return results


def import_csv(ws: Workspace, name: str, path: str, source: str = "manual_csv", as_of_date: str | None = None) -> DataFrame:
    """Manual CSV -> curated table, replacing it."""
    table = TABLES[name]
    rows = raw.read_file(ws.spark, path, raw.header(ws.spark, path))
    stamp = _now()
    batch_id = f"{source}_{name}_{uuid.uuid4().hex[:12]}"
    ready = add_lineage(rows, table, source, batch_id, as_of_date or stamp[:10], stamp)
    absent = missing_required(ready, table)
    if absent:
        raise ValueError("missing columns: " + ", ".join(absent))
    shaped = conform(ready, table)
    commit = uuid.uuid4().hex
    day = as_of_date or stamp[:10]
    with table_lock(ws.spark, ws.root, name):
        _write_counted(ws, name, shaped.withColumns({"in_": F.lit(1), "had_": F.lit(False)}), commit)
        facts = curated.partition_facts(curated.read_commit(ws.spark, ws.root, name, commit), name).collect()
        partitions = {
            f["partition"]: {"folder": curated.folder_of(name, commit, f["partition"]), "row_count": f["row_count"], "checksum": f["checksum"]}
            for f in facts
        }
        version_id = f"{name}_{uuid.uuid4().hex[:12]}"
        # no predecessor: what was promoted before is not in the new table
        curated.record_version(ws.spark, ws.root, name, version_id, day, partitions, None)
    return ws.version(name, version_id)


def check_quality(ws: Workspace, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, report) of the current tables."""
    versions = ws.versions()
    wanted = names or list(TABLES)
    active = {} if versions is None else {
        r["dataset_id"]: r for r in versions.filter("status = 'active'").collect()
    }
    present = [n for n in wanted if n in active]
    issues = ws.spark.createDataFrame(
        [(n, "current_version_missing", None, None, "issue") for n in wanted if n not in active and names],
        "dataset_id string, check_name string, column_name string, detail bigint, severity string",
    )
    for name in present:
        table_rows = ws.version(name, active[name]["curated_version_id"])
        issues = issues.unionByName(table_issues(table_rows, TABLES[name], active[name]["row_count"]))
    if present:
        issues = issues.unionByName(promotion_warnings(
            versions.filter("status = 'active' and notes is not null").select("dataset_id", "notes")
        ))
    listed = ws.spark.createDataFrame([(n,) for n in (wanted if names else present)], "dataset_id string")
    return issues, report(issues, listed)


def create_snapshot(ws: Workspace, as_of_date: str, config_version: str = "manual_config_v001") -> str:
    """Freeze the active versions under the next id of the date; refused on quality issues."""
    issues, _ = check_quality(ws)
    # at most a few per table and declared column
    failing = issues.filter("severity = 'issue'").orderBy("dataset_id", "check_name", "column_name").collect()
    if failing:
        named = [" ".join(str(r[c]) for c in ("dataset_id", "check_name", "column_name", "detail") if r[c] is not None) for r in failing]
        raise ValueError("snapshot refused: " + "; ".join(named))
    versions = ws.versions()
    if versions is None:
        raise ValueError("no current curated versions found")
    prefix = f"snapshot_{as_of_date.replace('-', '')}"
    known = ws.metadata("snapshot_manifests")
    number = 1
    if known is not None:
        same = known.filter(F.startswith("snapshot_id", F.lit(prefix + "_"))).withColumn("prefix", F.lit(prefix))
        row = next_number(same, "snapshot_id", ["prefix"]).first()
        number = row["next_number"] if row else 1
    snapshot_id = f"{prefix}_{number:03d}"
    manifest = snapshot_manifest(versions).select(
        F.lit(snapshot_id).alias("snapshot_id"), F.lit(as_of_date).alias("as_of_date"),
        F.current_timestamp().alias("created_at"), F.lit("daily").alias("data_frequency"),
        F.lit(config_version).alias("config_version"), "manifest_json", "dataset_count", "total_row_count",
    )
    curated.append_metadata(manifest, ws.root, "snapshot_manifests")
    return snapshot_id
