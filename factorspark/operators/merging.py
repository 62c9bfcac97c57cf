"""Keyed merging of curated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def coalescing_merge(
    existing: DataFrame | None, incoming: DataFrame, key: list[str], order: list[str] = (), counted: bool = False
) -> DataFrame:
    """Per key and column the last non-null value; a later null never erases.

    Rows of `incoming` follow all rows of `existing`; among themselves they follow the
    `order` columns (a batch number, say), which are not kept. Equal order falls back
    to the larger value, so the result does not depend on row order, which Spark does
    not have. The aggregate combines before its shuffle: a key repeated in a third of
    the rows arrives as one row per task. `counted` adds in_ (incoming rows of the key) and
    had_ (whether it existed), from which `overlap_of` is summed.
    """
    later = incoming.withColumn("side_", F.lit(1))
    rows = later
    if existing is not None:
        rows = existing.withColumn("side_", F.lit(0)).unionByName(later, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in {*key, *order, "side_"}]
    position = [F.col("side_"), *[F.col(c) for c in order]]

    def last_known(name: str) -> Column:
        ranked = F.struct(*position, F.col(name).alias("kept_"))
        return F.max(F.when(F.col(name).isNotNull(), ranked))["kept_"].alias(name)

    sides = [F.sum("side_").alias("in_"), F.min("side_").alias("new_")] if counted else []
    merged = rows.groupBy(*key).agg(*[last_known(c) for c in columns], *sides)
    kept = merged.select(*[c for c in rows.columns if c not in {*order, "side_"}], *[s for s in ("in_", "new_") if counted])
    return kept.withColumn("had_", F.col("new_") == 0).drop("new_") if counted else kept


def overlap_of(counted: str = "in_", had: str = "had_") -> list[Column]:
    """The aggregates of `overlap_summary` over the rows of a counted merge."""
    incoming, there = F.col(counted), F.col(had)
    return [
        F.coalesce(F.sum(incoming), F.lit(0)).alias("incoming_rows"),
        F.count_if(incoming > 1).alias("incoming_duplicate_keys"),
        F.count_if((incoming > 0) & there).alias("overlap_keys"),
    ]


def only_known_keys(incoming: DataFrame, current: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows whose key the current table already holds (none without a current table)."""
    if current is None:
        return incoming.limit(0)
    text = {c: F.col(c).cast("string") for c in key}
    same_types = all(dict(incoming.dtypes)[c] == dict(current.dtypes)[c] for c in key)
    if same_types:
        return incoming.join(current.select(*key), key, "left_semi")
    left = incoming.withColumns({f"{c}_k": v for c, v in text.items()})
    right = current.select(*[v.alias(f"{c}_k") for c, v in text.items()])
    names = [f"{c}_k" for c in key]
    return left.join(right, names, "left_semi").drop(*names)


def overlap_summary(existing: DataFrame | None, incoming: DataFrame, key: list[str]) -> DataFrame:
    """incoming_rows, incoming_duplicate_keys, overlap_keys from one shuffle of the keys."""
    text = [F.col(c).cast("string").alias(c) for c in key]
    keys = incoming.select(*text, F.lit(1).alias("in_"), F.lit(0).alias("had_"))
    if existing is not None:
        keys = keys.unionByName(existing.select(*text, F.lit(0).alias("in_"), F.lit(1).alias("had_")))
    per_key = keys.groupBy(*key).agg(F.sum("in_").alias("in_"), F.max("had_").alias("had_"))
    return per_key.agg(
        F.coalesce(F.sum("in_"), F.lit(0)).alias("incoming_rows"),
        F.count_if(F.col("in_") > 1).alias("incoming_duplicate_keys"),
        F.count_if((F.col("in_") > 0) & (F.col("had_") > 0)).alias("overlap_keys"),
    )


def duplicate_keys(frame: DataFrame, key: list[str]) -> DataFrame:
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_key_count(frame: DataFrame, key: list[str]) -> DataFrame:
    return duplicate_keys(frame, key).agg(F.count(F.lit(1)).alias("duplicate_keys"))


def merged_batch_ids(existing, incoming) -> Column:
    """Ordered-distinct union of two id arrays (one metadata row, not data)."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(existing, empty), F.coalesce(incoming, empty)))


def merged_batch_edges(existing: DataFrame, incoming: DataFrame, owner: str, batch: str, position: str) -> DataFrame:
    """The same union when the ids are rows: first side and position at which each id appears."""
    rows = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)))
    first = F.min(F.struct("side", position))
    return rows.groupBy(owner, batch).agg(first["side"].alias("side"), first[position].alias(position))


def latest_successful(batches: DataFrame, per: list[str]) -> DataFrame:
    """Newest successful batch per `per` columns."""
    newest = F.struct("retrieved_at", "batch_id")
    return (
        batches.filter(F.col("status") == "success")
        .groupBy(*per)
        .agg(F.max(newest).alias("newest_"))
        .select(*per, F.col("newest_.batch_id").alias("batch_id"), F.col("newest_.retrieved_at").alias("retrieved_at"))
    )


def with_version_status(versions: DataFrame) -> DataFrame:
    """Newest version per dataset is active, the others are inactive."""
    newest = versions.groupBy("dataset_id").agg(
        F.max(F.struct("created_at", "curated_version_id"))["curated_version_id"].alias("newest_")
    )
    active = F.col("curated_version_id") == F.col("newest_")
    return (
        versions.drop("status").join(newest, "dataset_id")
        .withColumn("status", F.when(active, "active").otherwise("inactive")).drop("newest_")
    )
