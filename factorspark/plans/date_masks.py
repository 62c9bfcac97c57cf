"""Masks of held dates, kept as notes on the folders of a curated table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import date_masks
from ..sources import curated_tables as curated
from . import folder_notes
from .promotion import Workspace

KIND = "date_masks"
MASKS_OF = {"daily_prices": date_masks.price_masks, "capital_flow_or_chip": date_masks.flow_masks}


def record(ws: Workspace, name: str, version_id: str | None = None) -> list[str]:
    """Take the masks of the folders of a version (the current one) that have none yet; returns these folders."""
    def take(fresh: list[str]) -> DataFrame:
        return MASKS_OF[name](curated.read_folders(ws.spark, ws.root, name, fresh, curated.own_folder().alias("folder")), ["folder"])

    return folder_notes.record(ws, KIND, name, folder_notes.folders_of(ws, name, version_id), take)


def read(ws: Workspace, name: str, version_id: str | None = None) -> DataFrame:
    """(dataset, symbol, month, days) of a version (the current one); folders without masks get theirs first."""
    version_id = version_id or curated.active_version(ws.spark, ws.root, name)
    record(ws, name, version_id)
    masks, _ = folder_notes.read(ws, KIND, name, folder_notes.folders_of(ws, name, version_id))
    if masks is None:
        return ws.spark.createDataFrame([], "dataset string, symbol string, month date, days int")
    return date_masks.combined(masks.drop("folder"))


def missing_by_symbol(ws: Workspace, name: str, calendar: DataFrame, datasets: list[str], symbols: DataFrame, start=None, end=None) -> DataFrame:
    """(dataset, symbol, trade_date) that the current version lacks, from its masks."""
    return date_masks.missing_by_symbol(calendar, datasets, symbols, read(ws, name), start, end)
