"""Notes on the folders of a curated table, kept beside its versions.

The folders of a version never change, so each is read for its notes once, in the first job after
the promotion that made it; a version's notes are those of the folders it lists. Notes are
written to a new folder and then named, so a job that failed leaves nothing that is read, and
notes recorded twice change nothing. Notes of folders no version lists are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources import curated_tables as curated
from .promotion import Workspace

RECORD = "dataset_id string, folder string, path string"


def recorded(ws: Workspace, kind: str, name: str) -> dict[str, str]:
    """folder -> where its notes lie (one entry per folder of the table)."""
    rows = ws.metadata(kind)
    return {} if rows is None else {r["folder"]: r["path"] for r in rows.filter(F.col("dataset_id") == name).collect()}


def folders_of(ws: Workspace, name: str, version_id: str | None = None) -> list[str]:
    """The folders of a version (the current one)."""
    version_id = version_id or curated.active_version(ws.spark, ws.root, name)
    return sorted({p["folder"] for p in curated.version_partitions(ws.spark, ws.root, version_id).values()}) if version_id else []


def record(ws: Workspace, kind: str, name: str, folders: list[str], take: Callable[[list[str]], DataFrame]) -> list[str]:
    """Write what `take` says of those folders that have no notes yet; returns these folders."""
    known = recorded(ws, kind, name)
    fresh = [folder for folder in folders if folder not in known]
    if not fresh:
        return []
    path = f"{kind}/{name}-{uuid.uuid4().hex}"
    take(fresh).write.mode("errorifexists").parquet(f"{ws.root.rstrip('/')}/{path}")
    named = ws.spark.createDataFrame([(name, f, path) for f in fresh], RECORD)
    curated.append_metadata(named, ws.root, kind)
    return fresh


def read(ws: Workspace, kind: str, name: str, folders: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(the notes of these folders, with their column `folder`; the folders that have none)."""
    known = recorded(ws, kind, name)
    noted = [f for f in folders if f in known]
    bare = [f for f in folders if f not in known]
    if not noted:
        return None, bare
    paths = sorted({f"{ws.root.rstrip('/')}/{known[f]}" for f in noted})
    listed = ws.spark.createDataFrame([(f,) for f in noted], "folder string")
    return ws.spark.read.parquet(*paths).join(listed, "folder", "left_semi"), bare
