"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label, and each positive asks for the best
rows of other labels whose score lies in a window below its own: between `low` hundredths of it
and itself. The windows of one anchor overlap, but their upper limits cut the scores into
disjoint slots: slot i holds what is at most the i-th limit and above the next. Each score falls
into one slot, and a combiner keeps the k best of each slot, first in each block of rows, then
over the blocks. A window is the slots from its own limit down, cut at its lower limit; as slots
fall, their lists one after the other are in order, and the first k of that suffix above the lower
limit are the answer. So every row is scored once per anchor, however many windows overlap, and
an anchor carries at most k rows for each positive.

Anchors meet the rows of their label, then all rows, in salted blocks of bounded size.

Defined results: rows without label or vector, or with a null or non-finite component, take no
part; a row meets the rows of its own width; repeated ids are rows of their own, and a row is
never its own positive; a row with a null id can be a positive or negative, last among ties, and
is no anchor; a positive with a score below zero has an empty window; whole numbers of any size
are exact, and a score beyond 64 bits is shown as the nearest one; extra columns are ignored; an
empty table, and an anchor without positives, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.runtime import materialise
from .block_search import BLOCK_QUERIES, BLOCK_ROWS, clean_vectors, hits, in_order, joined, meet, multipliable, side, stored, whole

SCALE = 256
K = 5
LOW = 80
_CHUNK = 64


def first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the first place first among ties."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= least)
        return rows[np.argsort(-scores[rows], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")


def _scores(queries: np.ndarray, rows: np.ndarray):
    """(place of the query, its products with all rows), some queries at a time."""
    for start in range(0, len(queries), _CHUNK):
        some = queries[start: start + _CHUNK]
        products = some @ rows.T if rows.shape[1] else np.zeros((len(some), len(rows)), np.int64)
        yield from ((start + i, products[i]) for i in range(len(some)))


def _sides(block: pa.Table, factor: int):
    asking, queries = side(block, True)
    candidates, rows = side(block, False)
    if asking.num_rows and candidates.num_rows:
        queries, rows = multipliable(whole(queries, SCALE), whole(rows, SCALE), width=rows.shape[1], factor=factor)
    return asking, queries, candidates, rows


def _positives(block: pa.Table, k: int) -> pa.Table:
    """The k best other rows of each anchor in a block of its label."""
    asking, queries, candidates, rows = _sides(block, 1)
    at, places, scores = [], [], []
    if asking.num_rows and candidates.num_rows:
        numbers, own = candidates.column("number").to_numpy(), asking.column("number").to_numpy()
        for i, products in _scores(queries, rows):
            other = np.flatnonzero(numbers != own[i])
            found = first_best(products[other], k)
            at.append(i)
            places.append(other[found])
            scores.append(products[other[found]])
    score, beyond = stored(joined(scores))
    return hits(asking, at, candidates, places, score=score, beyond=beyond)


def slot_best(scores: np.ndarray, limits: list[int], k: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, slots, first window) of the k best scores of each slot, as far as a window holds them.

    Limits fall. A score in slot s lies under the limits 0 to s, and within the windows from the
    first whose lower limit it reaches."""
    rows = np.flatnonzero((scores <= limits[0]) & (100 * scores >= low * limits[-1]))
    places, slots, firsts = [], [], []
    rising = np.array(limits[::-1], scores.dtype)
    slot = len(limits) - 1 - np.searchsorted(rising, scores[rows], "left")
    for s in np.unique(slot):
        inside = rows[slot == s]
        found = inside[first_best(scores[inside], k)]
        first = [next(i for i, limit in enumerate(limits) if 100 * score >= low * limit) for score in scores[found].tolist()]
        held = np.array(first) <= s
        places.append(found[held])
        slots.append(np.full(int(held.sum()), s))
        firsts.append(np.array(first)[held])
    return joined(places), joined(slots), joined(firsts)


def _slots(block: pa.Table, k: int, low: int) -> pa.Table:
    """The k best rows of other labels in each slot of each anchor, in a block of rows."""
    asking, queries, candidates, rows = _sides(block, 100)
    at, places, slots, firsts, scores = [], [], [], [], []
    if asking.num_rows and candidates.num_rows:
        labels, own = candidates.column("label").to_numpy(), asking.column("label").to_pylist()
        limits = [[limit_of(*pair) for pair in zip(some["score"], some["beyond"])] for some in asking.column("limits").to_pylist()]
        fits = 2**53 if rows.dtype == np.float64 else 2**62
        for i, products in _scores(queries, rows):
            other = np.flatnonzero(labels != own[i])
            mine = products[other]
            if mine.dtype != object and 100 * max(map(abs, limits[i])) >= fits:  # found in a block with wider numbers
                mine = mine.astype(np.int64).astype(object)
            found, slot, first = slot_best(mine, limits[i], k, low)
            at.append(i)
            places.append(other[found])
            slots.append(slot)
            firsts.append(first)
            scores.append(mine[found])
    score, beyond = stored(joined(scores))
    return hits(asking, at, candidates, places, score=score, beyond=beyond, slot=pa.array(joined(slots), pa.int32()),
                first=pa.array(joined(firsts), pa.int32()))


def limit_of(score: int, beyond: bytes) -> int:
    """The number that `stored` wrote."""
    if beyond[0] == 0x80:
        return score
    if beyond[0] == 0xFF:
        return int.from_bytes(beyond[5:], "big")
    return -int.from_bytes(bytes(255 - b for b in beyond[5:-1]), "big")


def next_of_ten(id_: Column, label: Column) -> Column:
    """The label, the next of ten where seven divides the id."""
    label = label.cast("long")
    return F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)


def mine(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100,
         k: int = K, positives: int = K, low: int = LOW, relabel=None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors whose id `every` divides.

    `relabel` (id, label -> label) replaces the labels first."""
    label = F.col(label_col) if relabel is None else relabel(F.col(id_col), F.col(label_col))
    rows = clean_vectors(table, id_col, vector_col, zero=True, more={"label": label}).where("label IS NOT NULL")
    kind = dict(rows.dtypes)["id"]
    schema = f"query_number long, query_id {kind}, vec_number long, vec_id {kind}, score long, beyond binary"
    anchors = rows.where(F.col("id") % every == 0)
    # First the positives of each anchor: its best rows within its label, from blocks of that label alone.
    found = meet(rows, anchors, ["width", "label"], lambda block: _positives(block, positives), schema, block_rows, block_queries)
    place = F.row_number().over(Window.partitionBy("query_number").orderBy(*in_order(True, True)))
    best = materialise(found.withColumn("place", place).where(F.col("place") <= positives), "mined-positives")
    # Upper limits, each once and falling; a window of a negative score is empty. `slot` is a positive's own limit.
    of = Window.partitionBy("query_number").orderBy(F.desc("score"), F.desc("beyond"))
    asked = best.where("score >= 0").withColumn("slot", F.dense_rank().over(of) - 1)
    limits = asked.groupBy("query_number").agg(F.array_sort(F.collect_set(F.struct("slot", "score", "beyond"))).alias("limits"))
    limited = anchors.join(limits.withColumnRenamed("query_number", "number"), "number").select(
        "number", "id", "vector", "width", "label", F.struct(F.col("limits.score").alias("score"), F.col("limits.beyond").alias("beyond")).alias("limits"))
    kind_of = dict(limited.dtypes)["limits"]
    everyone = rows.select("number", "id", "vector", "width", "label", F.lit(None).cast(kind_of).alias("limits"))
    # Then the slots of each anchor, over all rows of other labels.
    slotted = meet(everyone, materialise(limited, "mined-anchors"), ["width"], lambda block: _slots(block, k, low),
                   schema + ", slot int, first int", block_rows, block_queries)
    place = F.row_number().over(Window.partitionBy("query_number", "slot").orderBy(*in_order(True, True)))
    kept = slotted.withColumn("place", place).where(F.col("place") <= k)  # the blocks' lists of one slot, merged
    suffixes = kept.groupBy("query_number").agg(F.array_sort(F.collect_list(F.struct(
        "slot", "place", "first", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("falling"))
    window = F.filter("falling", lambda x: (x["slot"] >= F.col("slot")) & (x["first"] <= F.col("slot")))
    return (
        asked.join(suffixes, "query_number")
        .select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                F.posexplode(F.slice(window, 1, k)).alias("at", "n"))
        .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "n.negative_id", "positive_score", "n.negative_score"))
