"""Reading the rows of a few symbols from the files that can hold them.

Entries are taken from each new folder once (`record`); a reader takes what is recorded and opens
the folders without entries whole, so it is right before, during and after a recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import symbol_files
from ..sources import curated_tables as curated
from ..sources.schemas import TABLES
from . import folder_notes
from .promotion import Workspace

KIND = "symbol_files"


def record(ws: Workspace, name: str, version_id: str | None = None) -> list[str]:
    """Take the entries of the folders of a version (the current one) that have none yet; returns these folders."""
    def take(fresh: list[str]) -> DataFrame:
        rows = curated.read_folders(
            ws.spark, ws.root, name, fresh, curated.own_folder().alias("folder"), curated.own_file().alias("file"))
        return symbol_files.file_entries(rows.select("folder", "file", "symbol"))

    return folder_notes.record(ws, KIND, name, folder_notes.folders_of(ws, name, version_id), take)


def places(ws: Workspace, name: str, symbols: list[str], version_id: str | None = None) -> list[str]:
    """The files of a version (the current one) that can hold any of the symbols, and its folders without entries."""
    entries, bare = folder_notes.read(ws, KIND, name, folder_notes.folders_of(ws, name, version_id))
    if entries is None:
        return bare
    hits = entries.filter(symbol_files.can_hold(symbols)).select("file").distinct().collect()  # names of files to open
    return sorted([*bare, *(r["file"] for r in hits)])


def rows_of(ws: Workspace, name: str, symbols: list[str], version_id: str | None = None) -> DataFrame | None:
    """The rows of these symbols in a version (the current one); None when the table was never written.

    Null symbols are never asked for, repeated ones count once."""
    version_id = version_id or curated.active_version(ws.spark, ws.root, name)
    if version_id is None:
        return None
    wanted = sorted({s for s in symbols if s is not None})
    found = places(ws, name, wanted, version_id) if wanted else []
    if not found:
        return ws.spark.createDataFrame([], TABLES[name].schema)
    return curated.read_folders(ws.spark, ws.root, name, found).filter(F.col("symbol").isin(wanted))
