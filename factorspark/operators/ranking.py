"""Cross-sectional ranks.

Many columns ranked per day: the wide rows meet once by day, a task sorts the columns of one
day after the other, and nothing is stored or joined. Days of more than DAY_ROWS rows, and all
ranks of long rows, go the way of any size: rows are
range-partitioned on (group, value, tie-break), which splits a group with most of the
rows, and a value shared by a third of them, over tasks:

1. the sorted layout is written once with a running number, so all later steps agree on
   it even if an executor is lost; the number of parts follows from the counted rows;
2. a table with a row per group and part says where each group starts in a part and how
   many of its rows lie in earlier parts; with it, the running number gives the ordinal;
3. the average rank of a value that occurs more than once is the mean ordinal of its
   rows (combined before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.arrow_tasks import mean_ranks_of_days
from ..plans.runtime import materialise

PART_ROWS = 250_000
DAY_ROWS = 2_000_000  # a day of so many rows is ranked by one task: 16 MB a column


def _laid_out(rows: DataFrame, group: list[str], value: str, tie_break: list[str]) -> DataFrame:
    """Rows in rank order with ordinal_ and group_size of their group. `rows` is read twice."""
    keys = [F.col(c) for c in [*group, value, *tie_break]]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    laid_out = materialise(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("place_", F.monotonically_increasing_id()),
        "rank-layout",
    ).withColumn("part_", F.shiftright("place_", 33))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and part it touches: at most groups + parts rows
    starts = materialise(
        laid_out.groupBy(*group, "part_").agg(F.count(F.lit(1)).alias("rows_"), F.min("place_").alias("first_"))
        .select(
            *group, "part_", (F.coalesce(F.sum("rows_").over(earlier), F.lit(0)) + 1 - F.col("first_")).alias("shift_"),
            F.sum("rows_").over(whole).alias("group_size"),
        ),
        "rank-starts",
    )
    return (
        laid_out.join(starts, [*group, "part_"]).withColumn("ordinal_", F.col("place_") + F.col("shift_"))
        .drop("place_", "part_", "shift_")
    )


def ordinal_rank(
    rows: DataFrame, group: list[str], value: str, tie_break: list[str], name: str, stored: bool = False
) -> DataFrame:
    """1..n by (value, tie_break) in each group. `value` must not be null.

    `stored` rows are cheap to read again; others are written once first."""
    rows = rows if stored else materialise(rows, "rank-input")
    return _laid_out(rows, group, value, tie_break).withColumnRenamed("ordinal_", name).drop("group_size")


def long_average_rank(
    rows: DataFrame, group: list[str], value: str, tie_break: list[str], stored: bool = False
) -> DataFrame:
    """Adds avg_rank (ties share their mean rank) and group_size to long rows whose `value` is not null."""
    rows = rows if stored else materialise(rows, "rank-input")
    ranked = _laid_out(rows, group, value, tie_break)
    ties = (
        ranked.groupBy(*group, value).agg(
            F.count(F.lit(1)).alias("times_"), ((F.min("ordinal_") + F.max("ordinal_")) / F.lit(2.0)).alias("shared_"),
        ).filter(F.col("times_") > 1).drop("times_")
    )
    return (
        ranked.join(ties, [*group, value], "left")
        .withColumn("avg_rank", F.coalesce("shared_", F.col("ordinal_").cast("double"))).drop("shared_", "ordinal_")
    )


def crowded_days(rows: DataFrame, day: str = "trade_date") -> list:
    """Days of more than DAY_ROWS rows: at most one per DAY_ROWS rows of the table."""
    counted = rows.groupBy(day).agg(F.count(F.lit(1)).alias("rows_"))
    return [r[0] for r in counted.filter((F.col("rows_") > DAY_ROWS) & F.col(day).isNotNull()).collect()]


def split_days(rows: DataFrame, crowded: list, day: str = "trade_date") -> tuple[DataFrame, DataFrame | None]:
    """(rows of the other days, rows of the crowded days if there are any)."""
    if not crowded:
        return rows.filter(F.col(day).isNotNull()), None
    hit = F.col(day).isin(crowded)
    return rows.filter(~hit), rows.filter(hit)


def day_layout(rows: DataFrame, day: str, key: str) -> DataFrame:
    """Each day's rows in one task in order of `key`: place_ is 1 at its start, again_ marks the key of the row before."""
    order = Window.partitionBy(day).orderBy(key)
    again = F.coalesce(F.col(key) == F.lag(key).over(order), F.lit(False))
    placed = rows.withColumns({"place_": F.row_number().over(order), "again_": again})
    return placed.sortWithinPartitions(day, key)  # the window's own order: no further sort


def wide_average_ranks(
    frame: DataFrame, columns: list[str], day: str = "trade_date", key: str = "symbol", crowded: list | None = None
) -> DataFrame:
    """Adds <column>__rank and <column>__n for each column, ranked per date. A row without a key has no rank.

    `crowded` are the days to rank over many tasks, if the caller can count them at less cost than from `frame`."""
    rows, large = split_days(frame, crowded_days(frame, day) if crowded is None else crowded, day)
    result = T.StructType(
        [T.StructField(f"r{i}", T.DoubleType()) for i in range(len(columns))]
        + [T.StructField(f"n{i}", T.LongType()) for i in range(len(columns))]
    )
    ranks = F.arrow_udf(mean_ranks_of_days, result).asNondeterministic()
    ranked = day_layout(rows, day, key).withColumn(
        "ranks_", ranks("place_", "again_", *[F.col(c).cast("double") for c in columns]))
    found = ranked.select(
        *frame.columns,
        *[F.when(F.col(key).isNotNull(), F.col(f"ranks_.r{i}")).alias(f"{c}__rank") for i, c in enumerate(columns)],
        *[F.col(f"ranks_.n{i}").alias(f"{c}__n") for i, c in enumerate(columns)],
    )
    return found if large is None else found.unionByName(_stored_average_ranks(large, columns, day, key))


def _stored_average_ranks(frame: DataFrame, columns: list[str], day: str, key: str) -> DataFrame:
    """Days of any size. Only (key, date, factor, value) goes through the sort: the wide rows wait in storage."""
    base = materialise(frame, "cross-section")
    ranked = long_average_rank(unpivot(base, columns, [key, day]), ["factor", day], "value", [key], stored=True)
    chosen = [F.col("factor") == F.lit(c) for c in columns]
    wide = ranked.groupBy(key, day).agg(
        *[F.max(F.when(hit, F.col("avg_rank"))).alias(f"{c}__rank") for hit, c in zip(chosen, columns)]
    )
    counts = base.groupBy(day).agg(*[F.count(c).alias(f"{c}__n") for c in columns])
    return base.join(wide, [key, day], "left").join(counts, day)


def unpivot(frame: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Long rows (keep..., factor, value) without the nulls."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return frame.select(*keep, F.inline(entries)).filter(F.col("value").isNotNull())


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], top: int | None, name: str) -> DataFrame:
    """First `top` rows per group. Spark cuts each task's rows to `top` per group
    before the shuffle, so no task receives a whole group."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked if top is None else ranked.filter(F.col(name) <= top)
