"""Continuous promotion of landed batches.

The stream is the batch records: one small file per landed batch, written when the batch
is complete. A trigger reads the named batches by partition, so a batch is never split,
and merges them in order of landing. Triggers follow the order of the record files, which
is that of landing too, so the table does not depend on how many batches a trigger takes.
The merge is idempotent: a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.promotion import Workspace, promote_recorded
from ..plans.runtime import materialise, scratch
from ..sources.raw_batches import RECORD_SCHEMA


def promote_stream(ws: Workspace, dataset: str, checkpoint: str, created_at: str, batches_per_trigger: int | None = None):
    """Start a query that takes everything landed for `dataset` and stops."""
    reader = ws.spark.readStream.schema(RECORD_SCHEMA)
    if batches_per_trigger:
        reader = reader.option("maxFilesPerTrigger", batches_per_trigger)
    landed = reader.parquet(f"{ws.root.rstrip('/')}/metadata/data_batches").filter(
        (F.col("dataset_name") == dataset) & (F.col("status") == "success")
    )

    def merge(records: DataFrame, epoch: int) -> None:
        with scratch(ws.spark):
            by_landing = Window.orderBy("retrieved_at", "batch_id")  # the records of one trigger
            batches = materialise(records.withColumn("position", F.row_number().over(by_landing) - 1), "stream-batches")
            last = batches.agg(F.max_by("business_date", "position").alias("day")).first()["day"]
            if last is not None:
                promote_recorded(ws, dataset, batches, last, {"last_promoted_run_id": f"stream-{dataset}-{epoch}"}, created_at)

    return (
        landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
