"""Result tables of runs: factor runs, evaluations, rankings, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def factor_run_path(root: str) -> str:
    return f"{root.rstrip('/')}/factor_runs"


def write_factor_run(frame: DataFrame, root: str, run_id: str) -> None:
    """Typed Parquet under factor_run_id=..., so a run is found by partition pruning."""
    frame.write.mode("overwrite").parquet(f"{factor_run_path(root)}/factor_run_id={run_id}")


def read_factor_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.option("basePath", factor_run_path(root)).parquet(
        f"{factor_run_path(root)}/factor_run_id={run_id}"
    ).drop("factor_run_id")


def write_run_record(spark: SparkSession, root: str, run_id: str, **details) -> None:
    names = ["factor_run_id", *details]
    row = [run_id, *[None if v is None else str(v) for v in details.values()]]
    schema = ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([tuple(row)], schema).withColumn("created_at", F.current_timestamp().cast("string")).coalesce(
        1
    ).write.mode("append").json(f"{root.rstrip('/')}/factor_run_records")


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    schema = (
        "factor_run_id string, snapshot_id string, factor_version string, start_date string, end_date string, "
        "created_at string"
    )
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/factor_run_records")


def write_result(frame: DataFrame, root: str, run_id: str, name: str, form: str = "parquet") -> str:
    """One result table of a run as parquet, csv or json."""
    path = f"{root.rstrip('/')}/results/{run_id}/{name}"
    writer = frame.write.mode("overwrite")
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)
    return path


def read_result(spark: SparkSession, root: str, run_id: str, name: str, schema, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema).format(form)
    if form == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{root.rstrip('/')}/results/{run_id}/{name}")
