"""Exact top-k by integer inner product with MaxScore.

Each component is a term, whose postings are a column of the block. Shifted to its smallest
(or, for a negative query component, largest) value in the block a term never lowers a score,
and its bound is the query component times its range. Terms are taken by falling bound: those
whose remaining bounds together cannot lift a row over the threshold are non-essential. The
essential postings are traversed for all rows, the others probed only for rows that can still
reach the threshold, which rises as exact scores are found. Blocks of rows and of queries meet
in tasks of bounded size, and the shards' results are merged.

Defined results: see `clean_vectors` for rows that take no part (vectors of zeros do); a row
meets the rows of its own width; repeated ids are rows of their own, and a row never finds
itself; a row with a null id is found, last among ties, and never asks; numbers of any size
are exact, and a score beyond 64 bits is shown as the nearest one, its rank still the right
one; ties go to the smaller id; extra columns are ignored; an empty table gives no rows; fewer
than k candidates give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .block_search import BLOCK_QUERIES, BLOCK_ROWS, best, clean_vectors, hits, joined, meet, multipliable, side, stored, whole

SCALE = 1024
PROBE_TERMS = 8


def max_score(query: np.ndarray, own: int, postings: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k highest rows of a block, but for the place `own`; ties to the smaller place. postings: a row per term."""
    base = np.where(query >= 0, low, high)
    bounds = np.abs(query) * (high - low)
    order = np.argsort(-bounds, kind="stable")
    rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], np.zeros(1, bounds.dtype)])  # what the terms from here on can add
    constant = int(query @ base) if len(query) else 0  # what all rows have at least
    rows = np.flatnonzero(np.arange(postings.shape[1]) != own)
    ranked = lambda scores: np.argsort(-scores, kind="stable")
    if len(rows) <= k or not len(query):
        scores = query @ postings[:, rows] if len(query) else np.zeros(len(rows), np.int64)
        kept = ranked(scores)[:k]
        return rows[kept], scores[kept]
    # A first threshold: rows that look good in the strongest terms, scored in full.
    first = order[:PROBE_TERMS]
    partial = query[first] @ (postings[first][:, rows] - base[first, None])
    seeds = rows[np.argpartition(-partial, k - 1)[:k]]
    threshold = int((query @ postings[:, seeds]).min()) - constant
    # Essential: until the rest alone cannot reach the threshold.
    essential = int(np.searchsorted(-rest, -threshold, "right")) if threshold > 0 else len(order)
    essential = min(len(order), max(PROBE_TERMS, essential))
    terms = order[PROBE_TERMS:essential]
    if len(terms):
        partial = partial + query[terms] @ (postings[terms][:, rows] - base[terms, None])
    at = essential
    while True:
        alive = (partial + rest[at] >= threshold).astype(bool)
        rows, partial = rows[alive], partial[alive]
        if at == len(order):
            break
        terms = order[at: at + PROBE_TERMS]
        partial = partial + query[terms] @ (postings[terms][:, rows] - base[terms, None])
        at += len(terms)
        if len(rows) > k:  # all rows gain at least nothing from what is left
            threshold = max(threshold, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    kept = ranked(partial)[:k]
    return rows[kept], partial[kept] + constant


def _block(block: pa.Table, k: int) -> pa.Table:
    asking, queries = side(block, True)
    candidates, rows = side(block, False)
    at, places, scores = [], [], []
    if asking.num_rows and candidates.num_rows:
        # Doubles where they hold every sum exactly, wider numbers where a block has wide ones.
        queries, postings = multipliable(whole(queries, SCALE), whole(rows, SCALE), width=rows.shape[1], factor=2)
        postings = np.ascontiguousarray(postings.T)
        low, high = (postings.min(axis=1), postings.max(axis=1)) if len(postings) else (np.zeros(0), np.zeros(0))
        numbers = candidates.column("number").to_numpy()
        place_of = {number: place for place, number in enumerate(numbers)}
        for i, number in enumerate(asking.column("number").to_pylist()):
            found, values = max_score(queries[i], place_of.get(number, -1), postings, low, high, k)
            at.append(i)
            places.append(found)
            scores.append(values if values.dtype == object else values.astype(np.int64))
    score, beyond = stored(joined(scores))
    return hits(asking, at, candidates, places, score=score, beyond=beyond)


def top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10,
          block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id `every` divides, in all rows."""
    rows = clean_vectors(table, id_col, vector_col, zero=True)
    kind = dict(rows.dtypes)["id"]
    schema = f"query_number long, query_id {kind}, vec_number long, vec_id {kind}, score long, beyond binary"
    found = meet(rows, rows.where(F.col("id") % every == 0), ["width"], lambda block: _block(block, k), schema, block_rows, block_queries)
    return best(found, k, descending=True)
