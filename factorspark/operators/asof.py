"""As-of join: for each request the last row at or before its date.

Requests and rows are laid out together by (symbol, date bucket), so a symbol with a long
history, or with most of the requests, spreads over tasks. Inside a bucket one sorted pass
carries the last row forward. What a request finds before its bucket is one line per symbol
and bucket: the last row of each bucket, carried over the buckets of the symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def month_of(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def as_of(
    requests: DataFrame, rows: DataFrame, key: str = "symbol", requested: str = "as_of_date", day: str = "trade_date",
    bucket=month_of,
) -> DataFrame:
    """The requests with a struct `found` (the columns of `rows` but the key); null if there is no row at or before the date.

    Of rows of one key and date the greatest is found. Repeated requests are answered each; a null key or
    date finds nothing, and rows with one are not found.
    """
    names = [c for c in rows.columns if c != key]
    asked = requests.select(
        F.col(key).alias("key_"), F.col(requested).alias("day_"), F.struct(*requests.columns).alias("request_"), F.lit(1).alias("kind_"))
    held = rows.select(
        F.col(key).alias("key_"), F.col(day).alias("day_"), F.struct(F.col(day).alias("day_"), F.struct(*names).alias("row_")).alias("last_"),
        F.lit(0).alias("kind_"),
    ).where(F.col("key_").isNotNull() & F.col("day_").isNotNull())
    held = held.groupBy("key_", "day_", "kind_").agg(F.max("last_").alias("last_"))  # combines before its shuffle
    placed = asked.unionByName(held, allowMissingColumns=True).withColumn("bucket_", bucket(F.col("day_")))
    inside = Window.partitionBy("key_", "bucket_").orderBy("day_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = placed.withColumn("inside_", F.last("last_", ignorenulls=True).over(inside)).where("kind_ = 1")
    # one line per key and bucket that holds rows or requests
    lines = placed.groupBy("key_", "bucket_").agg(F.max("last_").alias("last_"))
    earlier = Window.partitionBy("key_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.select("key_", "bucket_", F.last("last_", ignorenulls=True).over(earlier).alias("before_"))
    found = F.coalesce("inside_", "before_")
    answered = carried.where(F.col("key_").isNotNull() & F.col("day_").isNotNull()).join(before, ["key_", "bucket_"])
    empty = carried.where(F.col("key_").isNull() | F.col("day_").isNull()).withColumn("before_", F.lit(None).cast(dict(before.dtypes)["before_"]))
    whole = answered.unionByName(empty.withColumn("inside_", F.col("before_")))
    return whole.select("request_.*", found["row_"].alias("found"))
