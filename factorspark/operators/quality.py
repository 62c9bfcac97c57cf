"""Quality checks of curated tables, as long-form issue rows.

Columns of every check: dataset_id, check_name, column_name, detail, severity.
Issues (severity 'issue') fail a table; warnings do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.schemas import CuratedTable
from .enforcement import null_counts
from .merging import duplicate_key_count

ISSUE_SCHEMA = "dataset_id string, check_name string, column_name string, detail bigint, severity string"


def _issue(dataset, check: str, column: Column | None = None, detail: Column | None = None, severity="issue"):
    as_column = lambda v, t: F.lit(None).cast(t) if v is None else v
    return [
        (F.lit(dataset) if isinstance(dataset, str) else dataset).alias("dataset_id"),
        F.lit(check).alias("check_name"),
        as_column(column, "string").alias("column_name"),
        as_column(detail, "bigint").cast("bigint").alias("detail"),
        F.lit(severity).alias("severity"),
    ]


def resolve_targets(requested: DataFrame, datasets: DataFrame, schema_versions: DataFrame, current: DataFrame) -> DataFrame:
    """Requested ids with what the catalogue knows about them."""
    return (
        requested.join(datasets.select("dataset_id", F.lit(True).alias("registered")), "dataset_id", "left")
        .join(schema_versions.select("dataset_id", "schema_version_id"), "dataset_id", "left")
        .join(current.select("dataset_id", "curated_version_id", "path", "row_count"), "dataset_id", "left")
        .withColumn("registered", F.coalesce("registered", F.lit(False)))
    )


def catalogue_issues(targets: DataFrame) -> DataFrame:
    """Not registered, without schema, without current version."""
    unknown = ~F.col("registered")
    found = F.array(
        F.when(unknown, F.lit("not_registered")),
        F.when(~unknown & F.col("schema_version_id").isNull(), F.lit("schema_missing")),
        F.when(~unknown & F.col("curated_version_id").isNull(), F.lit("current_version_missing")),
        F.when(F.col("curated_version_id").isNotNull() & F.col("path").isNull(), F.lit("path_missing")),
    )
    return targets.select("dataset_id", F.explode(F.array_compact(found)).alias("check_name")).select(
        "dataset_id", "check_name", F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("bigint").alias("detail"), F.lit("issue").alias("severity"),
    )


def row_count_issues(frame: DataFrame, dataset: str, recorded: int | Column | None) -> DataFrame:
    """Empty table, and a recorded count that differs. The count reads no data column."""
    counted = frame.agg(F.count(F.lit(1)).alias("actual_"))
    empty = counted.filter("actual_ = 0").select(*_issue(dataset, "empty", detail=F.col("actual_")))
    if recorded is None:
        return empty
    differs = counted.filter(F.col("actual_") != F.lit(recorded)).select(
        *_issue(dataset, "row_count_mismatch", detail=F.col("actual_") - F.lit(recorded))
    )
    return empty.unionByName(differs)


def column_issues(spark: SparkSession, columns: list[str], table: CuratedTable, dataset: str) -> DataFrame:
    """Schema difference of the header; no data is read."""
    rows = [(dataset, "missing_column", c, None, "issue") for c in table.columns if c not in columns]
    rows += [(dataset, "extra_column", c, None, "issue") for c in columns if c not in table.columns]
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def null_issues(frame: DataFrame, table: CuratedTable, dataset: str) -> DataFrame:
    required = [c for c in table.columns if c in table.required and c in frame.columns]
    return null_counts(frame, required).filter("null_count > 0").select(
        *_issue(dataset, "nulls_in_required", F.col("column"), F.col("null_count"))
    )


def duplicate_issues(frame: DataFrame, table: CuratedTable, dataset: str) -> DataFrame:
    key = [c for c in table.key if c in frame.columns]
    return duplicate_key_count(frame, key).filter("duplicate_keys > 0").select(
        *_issue(dataset, "duplicate_primary_keys", F.lit(",".join(key)), F.col("duplicate_keys"))
    )


def promotion_warnings(notes: DataFrame) -> DataFrame:
    """Overlap and duplicate counts noted by the last promotion. Input: dataset_id, notes (JSON)."""
    def noted(name):
        return F.get_json_object("notes", f"$.last_promote_overlap.{name}").try_cast("bigint")

    found = F.array(
        F.struct(F.lit("overlapping_keys").alias("check_name"), noted("overlap_keys").alias("detail")),
        F.struct(F.lit("incoming_duplicate_keys").alias("check_name"), noted("incoming_duplicate_keys").alias("detail")),
    )
    last = F.coalesce(
        F.get_json_object("notes", "$.last_promoted_batch_id"),
        F.get_json_object("notes", "$.last_promoted_run_id"), F.lit("unknown"),
    )
    return (
        notes.select("dataset_id", last.alias("column_name"), F.inline(found))
        .filter(F.col("detail") > 0)
        .select("dataset_id", "check_name", "column_name", "detail", F.lit("warning").alias("severity"))
    )


def table_issues(frame: DataFrame, table: CuratedTable, recorded: int | None = None) -> DataFrame:
    """All checks of one table."""
    parts = [
        row_count_issues(frame, table.name, recorded),
        column_issues(frame.sparkSession, frame.columns, table, table.name),
        null_issues(frame, table, table.name),
        duplicate_issues(frame, table, table.name),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(issues: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row per dataset: counts and whether it passes."""
    counted = issues.groupBy("dataset_id").agg(
        F.count_if(F.col("severity") == "issue").alias("issue_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        datasets.select("dataset_id").join(counted, "dataset_id", "left")
        .select(
            "dataset_id",
            F.coalesce("issue_count", zero).alias("issue_count"),
            F.coalesce("warning_count", zero).alias("warning_count"),
        )
        .withColumn("passed", F.col("issue_count") == 0)
    )
