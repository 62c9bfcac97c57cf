"""Mixing sources to target weights.

Tokens are aggregated per source; targets share all tokens by weight, held at `most` times
what a source has, with the excess shared again. A source's rate is target / size; each of
its documents is taken floor(rate) times and once more if a draw hashed from the seed, its
id and its text is below the fraction.

Defined results: a null text has size 0; the null source is one source, last in order; a
source without words has target 0; rows that are equal in id and text draw alike; an empty
table gives no rows; extra columns are ignored (`mix_plan`) or kept (`mix`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.runtime import materialise
from .common import private, uniform

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 7


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The sources are numbered in their order by a range sort, whose parts are counted, so that
    no task needs all of them. Each round of sharing is one aggregate over the sources.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = materialise(
        per_source.orderBy(F.asc_nulls_last("source")).withColumn("place", F.monotonically_increasing_id()), "mix-order")
    placed = placed.withColumn("part", F.shiftright("place", 33)).withColumn("inside", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of the sort
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("inside") + F.col("before")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int"))
    sources = materialise(placed.join(offsets, "part").select("source", "source_size", weight.alias("weight")), "mix-sources")
    level, held = 0.0, -1
    while True:
        full = F.col("source_size") * most < F.lit(level) * F.col("weight")
        total, capped, open_weight, count = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * most)),
            F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if count == held or not total:
            break
        level, held = (total - (capped or 0)) / open_weight, count
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _copies(rate: Column, draw: Column) -> Column:
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
        uniform(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw")), "mix-sizes")
    targets = source_targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", "of")
    return sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target",
        (_copies(_rate(), F.col("draw")) * F.col("size")).alias("taken"), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it."""
    sizes = docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    of, rate, copy = private(docs, "of_", "rate_", "copy_")
    rates = source_targets(sizes, weights, most).select(F.col("source").alias(of), _rate().alias(rate))
    copies = _copies(F.col(rate), uniform(F.lit(seed), F.col(id_col), F.col(text_col))).cast("int")
    return (
        docs.join(rates, F.col(source_col).eqNullSafe(F.col(of)))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns))
