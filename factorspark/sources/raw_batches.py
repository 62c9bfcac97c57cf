"""The raw landing zone: Hive-partitioned CSV batches.

<root>/source=/dataset=/as_of_date=/batch_id=/*.csv. Selecting batches is partition
pruning; values are read as text and typed by the mapping that follows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PARTITIONS = ["source", "dataset", "as_of_date", "batch_id"]


def write_batch(frame: DataFrame, root: str, source: str, dataset: str, as_of_date: str, batch_id: str) -> str:
    """Land one batch. Batches are immutable: an existing one is an error."""
    path = f"{root}/source={source}/dataset={dataset}/as_of_date={as_of_date}/batch_id={batch_id}"
    frame.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_batches(frame: DataFrame, root: str) -> None:
    """Land many batches at once; `frame` carries the four partition columns.

    The rebalance hint gathers each batch and splits one that holds most of the rows
    over several files."""
    frame.hint("rebalance", *PARTITIONS).write.mode("append").partitionBy(*PARTITIONS).option("header", True).csv(root)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *PARTITIONS]])


def read_batches(spark: SparkSession, root: str, columns: list[str], **selected) -> DataFrame:
    """Batches under `root`, restricted to the given partition values."""
    rows = spark.read.schema(text_schema(columns)).option("header", True).csv(root)
    for name, value in selected.items():
        values = [value] if isinstance(value, str) else list(value)
        rows = rows.filter(F.col(name).isin(values))
    return rows


def read_recorded(spark: SparkSession, root: str, batches: DataFrame) -> list[DataFrame]:
    """The rows of recorded batches, one frame per column layout among them.

    `batches` are rows of the batch records; what else they hold (an order, say) is joined to
    the rows. One partitioned read per layout, whatever the number of batches: the join on
    the partition columns prunes the folders.
    """
    keys = {"source": "source", "dataset_name": "dataset", "business_date": "as_of_date", "batch_id": "batch_id"}
    wanted = batches.drop("raw_path", "format", "row_count", "schema_hash", "content_checksum", "status").withColumnsRenamed(keys)
    layouts = [row["columns"] for row in batches.select("columns").distinct().collect()]  # few, set by the provider
    return [
        read_batches(spark, root, json.loads(layout)).join(wanted.filter(F.col("columns") == layout).drop("columns"), PARTITIONS)
        for layout in sorted(layouts)
    ]


def read_file(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV batch (reads the first line only)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def stack_batches(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column some batches lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def schema_hash(columns: list[str]):
    return F.sha2(F.concat_ws(",", *[F.lit(c) for c in columns]), 256)


def content_checksum(columns: list[str]):
    """Order-free fingerprint of the rows, as an aggregate: partial results combine.

    An exact sum, in which equal rows do not cancel; which values are null is hashed too,
    as a hash over columns skips them."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    row = F.xxhash64(nulls, *columns).cast("decimal(20,0)")
    return F.coalesce(F.sum(row), F.lit(0)).cast("string")


def batch_record(batch: DataFrame, source: str, dataset: str, as_of_date: str, batch_id: str, path: str) -> DataFrame:
    """The metadata row of a landed batch."""
    columns = [c for c in batch.columns if c not in PARTITIONS]
    return batch.agg(
        F.count(F.lit(1)).alias("row_count"), content_checksum(columns).alias("content_checksum")
    ).select(
        F.lit(batch_id).alias("batch_id"), F.lit(source).alias("source"), F.lit(dataset).alias("dataset_name"),
        F.current_timestamp().alias("retrieved_at"), F.lit(as_of_date).alias("business_date"),
        F.lit(path).alias("raw_path"), F.lit("csv").alias("format"), "row_count",
        schema_hash(columns).alias("schema_hash"), "content_checksum", F.lit("success").alias("status"),
        F.lit(json.dumps(columns)).alias("columns"),
    )


#: The records as they are stored, for streams.
RECORD_SCHEMA = (
    "batch_id string, source string, dataset_name string, retrieved_at timestamp, business_date string, raw_path string, "
    "format string, row_count bigint, schema_hash string, content_checksum string, status string, columns string"
)
