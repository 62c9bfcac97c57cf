"""Blocks for searches of a query set in all rows: numbered vectors, salted blocks, exact whole numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.runtime import materialise

BLOCK_ROWS = 65536
BLOCK_QUERIES = 4096
#: Few rows still make some blocks, so that small tables use more than one task.
LEAST_ROWS = 1024
FEW_BLOCKS = 8
_LONG = 1 << 63
_INSIDE = b"\x80"


def clean_vectors(table: DataFrame, id_col: str, vector_col: str, zero: bool, more: dict[str, Column] | None = None) -> DataFrame:
    """The rows (number, id, vector, width, *more) that take part, stored once; every row has a number of its own.

    Out are: null vectors; null, infinite or not-a-number components; without `zero`, vectors that
    hold nothing but zeros. A row keeps its null or repeated id, and its width, whatever it is.
    """
    vector = F.col("vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    test = vector.isNotNull() & F.coalesce(finite, F.lit(False))
    if not zero:
        test = test & F.exists(vector, lambda x: x != 0)
    more = more or {}
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                        *(column.alias(name) for name, column in more.items())).where(test)
    return materialise(rows.select(F.monotonically_increasing_id().alias("number"), "id", "vector", F.size("vector").alias("width"), *more),
                       "search-vectors")


def every_of(count) -> Column:
    """One row for each number below `count`."""
    last = (count if isinstance(count, Column) else F.lit(count)).cast("long") - 1
    return F.explode(F.sequence(F.lit(0).cast("long"), last))


def meet(candidates: DataFrame, queries: DataFrame, by: list[str], task: Callable[[pa.Table], pa.Table], schema: str,
         block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """`task` over blocks of candidates and queries of one group (`by`): every pair of a group meets in one block.

    Both sides hold `number` and the columns the task needs, under the same names. A group is dealt
    into blocks by its counted rows, so that no block grows with the data or with a hot group.
    """
    held = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("held_"))
    asked = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("asked_"))
    ceiling = lambda name, most: F.ceil(F.col(name) / F.lit(most)).cast("long")
    some = F.least(F.lit(FEW_BLOCKS).cast("long"), F.floor(F.col("held_") / LEAST_ROWS).cast("long"))
    sizes = materialise(held.join(asked, by).select(
        *by, F.greatest(F.lit(1).cast("long"), some, ceiling("held_", block_rows)).alias("shards_"),
        F.greatest(F.lit(1).cast("long"), ceiling("asked_", block_queries)).alias("askings_")), "search-blocks")
    draw = F.xxhash64(F.lit(23), "number")
    names = [c for c in candidates.columns if c not in by]
    placed = candidates.join(sizes, by).select(
        *by, *names, F.pmod(draw, "shards_").alias("shard_"), every_of(F.col("askings_")).alias("asking_"), F.lit(False).alias("query_"))
    asking = queries.join(sizes, by).select(
        *by, *names, every_of(F.col("shards_")).alias("shard_"), F.pmod(draw, "askings_").alias("asking_"), F.lit(True).alias("query_"))
    return placed.unionByName(asking).groupBy(*by, "shard_", "asking_").applyInArrow(task, schema)


def side(block: pa.Table, query: bool) -> tuple[pa.Table, np.ndarray]:
    """The queries or the candidates of a block, by id (null last) and number, and their vectors."""
    part = block.filter(pa.compute.equal(block.column("query_"), query)).sort_by([("id", "ascending"), ("number", "ascending")])
    flat = part.column("vector").combine_chunks()
    if isinstance(flat, pa.ChunkedArray):  # of no chunks
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.list_(pa.float64()))
    return part, np.asarray(flat.flatten(), np.float64).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, 0))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit numbers where all fit, else Python's."""
    if not values.size or float(np.abs(values).max()) < 2.0**62 / scale:
        return np.floor(scale * values).astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x)  # a larger double is a whole number
    return np.array([exact(float(x)) for x in values.ravel()], object).reshape(values.shape)


def multipliable(*parts: np.ndarray, width: int, factor: int = 1) -> list[np.ndarray]:
    """The whole numbers in the fastest type whose sums of `width` products, times `factor`, are exact."""
    most = factor * max(1, width)
    for part in parts[:2]:
        most *= max(1, int(max(abs(int(part.max())), abs(int(part.min()))))) if part.size else 1
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    return [part.astype(kind) for part in parts]


def stored(scores: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(score, beyond): 64-bit scores, the nearest one for those outside, which `beyond` puts in order among themselves."""
    if scores.dtype != object:
        return pa.array(scores.astype(np.int64)), pa.array([_INSIDE] * len(scores), pa.binary())
    shown, beyond = [], []
    for score in scores.tolist():
        if -_LONG <= score < _LONG:
            shown.append(score)
            beyond.append(_INSIDE)
            continue
        size = abs(score)
        key = len(f"{size:x}").to_bytes(4, "big") + size.to_bytes(-(-size.bit_length() // 8), "big")
        shown.append(_LONG - 1 if score > 0 else -_LONG)
        beyond.append(b"\xff" + key if score > 0 else b"\x00" + bytes(255 - b for b in key) + b"\xff")
    return pa.array(shown, pa.int64()), pa.array(beyond, pa.binary())


def in_order(descending: bool, beyond: bool) -> list[Column]:
    """Best score first, ties to the smaller id, null ids last."""
    score = [F.col("score"), *([F.col("beyond")] if beyond else [])]
    return [*(c.desc() if descending else c.asc() for c in score), F.col("vec_id").asc_nulls_last(), F.col("vec_number")]


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query row."""
    order = in_order(descending, "beyond" in found.columns)
    rank = F.row_number().over(Window.partitionBy("query_number").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hits(query: pa.Table, at: list[int], rows: pa.Table, places: list[np.ndarray], **columns) -> pa.Table:
    """One line per hit: query `at[i]` found the rows `places[i]`."""
    asked = pa.array(np.repeat(np.array(at, np.int64), [len(p) for p in places]))
    found = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
    return pa.table({
        "query_number": query.column("number").take(asked), "query_id": query.column("id").take(asked),
        "vec_number": rows.column("number").take(found), "vec_id": rows.column("id").take(found), **columns})


def joined(parts: list[np.ndarray], empty=np.int64) -> np.ndarray:
    """One column of the parts, of Python's numbers if any part has them."""
    if not parts:
        return np.zeros(0, empty)
    if any(p.dtype == object for p in parts):
        parts = [np.array([int(x) for x in p.tolist()] + [0], object)[:-1] for p in parts]
    return np.concatenate(parts)
