"""Exact medians of groups of any size by selection over range parts.

A sketch of each group gives boundaries that cut its values into parts; counts per part, which
combine before their shuffle, tell which part holds the middle; only that part is looked at
again. A part that is still large is cut in the same way. So no task ever holds, or sorts, a
whole group, and a value shared by most rows is a part of its own that needs no second look.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.runtime import materialise

PARTS = 256
MOST_ROWS = 1_000_000


def exact_median(rows: DataFrame, value: str, group: list[str] = (), parts: int = PARTS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(*group, median) of the values that are not null; the mean of the two middle ones of an even number.

    Parts of at most `most_rows` rows are counted by value and run through in order. A group without values has no row.
    """
    given = rows.select(*group, F.col(value).cast("double").alias("value_")).where("value_ IS NOT NULL")
    # One text per group, in which nulls are values too; a part adds its number.
    keyed = materialise(given.select(
        F.to_json(F.struct(F.lit(0).alias("_"), *group)).alias("path_"), "value_", F.struct(F.lit(0).alias("_"), *group).alias("group_")), "median-rows")
    sizes = keyed.groupBy("path_").agg(F.count(F.lit(1)).alias("n_"), F.first("group_").alias("group_"))
    targets = materialise(sizes.select(
        "group_", "path_", F.explode(F.array_distinct(F.array(
            F.floor((F.col("n_") + 1) / 2).cast("long"), (F.floor(F.col("n_") / 2) + 1).cast("long")))).alias("place_")), "median-targets")
    rest, known = keyed.select("path_", "value_"), []
    while True:
        largest = rest.groupBy("path_").count().agg(F.max("count")).first()[0]
        if largest is None or largest <= most_rows:
            break
        rest, targets, found = _narrowed(rest, targets, parts)
        known.append(found)
    counts = rest.groupBy("path_", "value_").agg(F.count(F.lit(1)).alias("times_"))
    so_far = F.sum("times_").over(Window.partitionBy("path_").orderBy("value_"))
    places = counts.withColumn("last_", so_far).join(targets, "path_").where(
        (F.col("place_") <= F.col("last_")) & (F.col("place_") > F.col("last_") - F.col("times_")))
    found = places.select("group_", "value_")
    for more in known:
        found = found.unionByName(more)
    middle = found.groupBy("group_").agg(F.avg("value_").alias("median"))
    return middle.select(*[F.col(f"group_.{c}").alias(c) for c in group], "median")


def _narrowed(rest: DataFrame, targets: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the parts that hold a target, the targets inside them, and the values of targets in parts of one value."""
    cuts = F.percentile_approx("value_", F.lit([i / parts for i in range(1, parts)]), F.lit(100 * parts))
    # one row per open part, with at most `parts` boundaries
    bounds = materialise(rest.groupBy("path_").agg(F.array_sort(F.array_distinct(cuts)).alias("cuts_")), "median-bounds")
    below = F.size(F.filter("cuts_", lambda b: b < F.col("value_")))
    # a boundary is a part of its own, so that many rows of one value are one part
    part = F.when(F.array_contains("cuts_", F.col("value_")), 2 * below + 1).otherwise(2 * below)
    cut = materialise(rest.join(bounds, "path_").select("path_", "value_", part.alias("part_")), "median-parts")
    counted = cut.groupBy("path_", "part_").agg(
        F.count(F.lit(1)).alias("rows_"), F.min("value_").alias("least_"), F.max("value_").alias("greatest_"))
    last = F.sum("rows_").over(Window.partitionBy("path_").orderBy("part_"))
    held = materialise(
        counted.withColumn("last_", last).join(targets, "path_").where(
            (F.col("place_") <= F.col("last_")) & (F.col("place_") > F.col("last_") - F.col("rows_"))), "median-held")
    found = held.where("least_ = greatest_").select("group_", F.col("least_").alias("value_"))
    open_ = held.where("least_ <> greatest_")
    path = F.concat_ws("/", "path_", F.col("part_").cast("string"))
    inside = open_.select("path_", "part_").distinct()
    rest = materialise(cut.join(inside, ["path_", "part_"]).select(path.alias("path_"), "value_"), "median-rest")
    targets = materialise(open_.select(
        "group_", path.alias("path_"), (F.col("place_") - F.col("last_") + F.col("rows_")).alias("place_")), "median-targets")
    return rest, targets, found
