"""Looking at stored tables, batches and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog
from ..sources.schemas import TABLES
from . import symbol_files
from .promotion import Workspace


def _metadata(ws: Workspace, name: str) -> DataFrame:
    rows = ws.metadata(name)
    if rows is None:
        raise ValueError(f"no {name.replace('_', ' ')} recorded")
    return rows


def preview_curated(ws: Workspace, dataset: str, symbol=None, start=None, end=None, columns=None, limit: int = 20) -> DataFrame:
    """Newest rows first; of one symbol only the files are opened that can hold it (see `symbol_files`)."""
    by_symbol = bool(symbol) and dataset in TABLES and "symbol" in TABLES[dataset].columns
    frame = symbol_files.rows_of(ws, dataset, [symbol]) if by_symbol else ws.current(dataset)
    if frame is None:
        raise ValueError(f"no current curated version found for dataset: {dataset}")
    return catalog.preview(frame, dataset, ws.current("security_master"), symbol, start, end, columns, limit)


def inspect_curated(ws: Workspace, dataset: str) -> DataFrame:
    version = ws.versions()
    frame = ws.current(dataset)
    if version is None or frame is None:
        raise ValueError(f"no current curated version found for dataset: {dataset}")
    active = version.filter((F.col("dataset_id") == dataset) & (F.col("status") == "active"))
    return catalog.inspect_version(active, frame)


def list_runs(ws: Workspace, limit: int = 20) -> DataFrame:
    return catalog.list_runs(_metadata(ws, "data_batches"), limit)


def inspect_run(ws: Workspace, batch_id: str) -> DataFrame:
    """The batch with the versions that contain it, later ones included, and the snapshots that contain those."""
    batch = _metadata(ws, "data_batches").filter(F.col("batch_id") == batch_id)
    if batch.isEmpty():
        raise ValueError(f"batch not found: {batch_id}")
    edges, versions = ws.metadata("version_batches"), ws.metadata("curated_versions")
    if edges is None or versions is None:  # nothing promoted yet
        return batch.withColumns({c: F.lit(None).cast("string") for c in ("curated_version_id", "snapshot_id")})
    snapshots = ws.metadata("snapshot_manifests")
    if snapshots is None:
        members = edges.select("curated_version_id", F.lit(None).cast("string").alias("snapshot_id")).limit(0)
    else:
        members = catalog.inspect_snapshot(snapshots).select("curated_version_id", "snapshot_id")
    return batch.join(catalog.run_lineage(batch, edges, versions, members), "batch_id", "left")


def inspect_snapshot(ws: Workspace, snapshot_id: str) -> DataFrame:
    return catalog.inspect_snapshot(_metadata(ws, "snapshot_manifests").filter(F.col("snapshot_id") == snapshot_id))
