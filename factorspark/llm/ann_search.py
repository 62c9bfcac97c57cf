"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gets a neighbour graph, which is cut into balanced partitions
by repeated spectral bisection. A softmax classifier learns to tell a vector's partition. It
files every row under its most probable partition and sends a query to the several most
probable ones, whose rows are ranked by exact distance. How many are probed follows from the
sample: the fewest that find the wanted share of its true neighbours. Partitions of many rows
are split into salted blocks, each query visiting all of them, and many queries into blocks
as well, so no block grows with the data.

Defined results: see `clean_vectors` for rows that take no part; a row meets the rows of its
own width, and those of another width than most (the smaller on a tie) all meet each other;
repeated ids are rows of their own, and a row never finds itself; a row with a null id is
found, last among ties, and never asks; equal distances go to the smaller id; extra columns
are ignored; an empty table gives no rows; a query whose partitions hold fewer than k rows
searches all, and fewer than k candidates give all; all rows are probed where there is one
partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import materialise
from .block_search import best, clean_vectors, hits, joined, meet, side
from .common import hashed_share, uniform, vectors

SAMPLE_ROWS = 4096
PARTITION_ROWS = 1024
MOST_PARTITIONS = 128
BLOCK_ROWS = 16384
BLOCK_QUERIES = 8192
NEIGHBOURS = 10
RECALL = 0.94


def neighbour_graph(sample: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    squares = (sample**2).sum(axis=1)
    out = np.zeros((len(sample), k), np.int64)
    for start in range(0, len(sample), 512):
        stop = min(len(sample), start + 512)
        far = squares[start:stop, None] + squares - 2 * sample[start:stop] @ sample.T
        far[np.arange(stop - start), np.arange(start, stop)] = np.inf
        out[start:stop] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 60) -> np.ndarray:
    """A partition of each node: halves of equal size along the graph's slowest mode, again and again."""
    label = np.zeros(len(graph), np.int64)
    a = np.repeat(np.arange(len(graph)), graph.shape[1])
    b = graph.ravel()
    count = 1
    while count < parts:
        inside = label[a] == label[b]
        ends, others = a[inside], b[inside]
        degree = np.bincount(ends, minlength=len(graph)) + np.bincount(others, minlength=len(graph)) + 1.0
        size = np.bincount(label, minlength=count)
        mode = rng.normal(size=len(graph))
        for _ in range(rounds):
            mode = mode - (np.bincount(label, mode, minlength=count) / np.maximum(size, 1))[label]
            spread = np.bincount(ends, mode[others], minlength=len(graph)) + np.bincount(others, mode[ends], minlength=len(graph))
            mode = 0.5 * mode + 0.5 * (spread + mode) / degree
            mode /= np.abs(mode).max() + 1e-300
        order = np.lexsort((np.arange(len(graph)), mode, label))
        place = np.empty(len(graph), np.int64)
        place[order] = np.arange(len(graph)) - np.concatenate([[0], np.cumsum(size)])[label[order]]
        label = 2 * label + (2 * place >= size[label])
        count *= 2
    return label


@dataclass(frozen=True)
class Router:
    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray
    probes: int

    def ranked(self, rows: np.ndarray, most: int) -> np.ndarray:
        """The most probable partitions of each row, the first first."""
        logits = np.maximum(rows @ self.hidden + self.hidden_bias, 0) @ self.output + self.output_bias
        return np.argsort(-logits, axis=1, kind="stable")[:, :most]


def _train(rows: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator, width: int = 128, epochs: int = 30) -> Router:
    """One hidden layer and a softmax, by SGD with momentum."""
    dim = rows.shape[1]
    scale = 1 / (np.sqrt((rows**2).mean()) + 1e-300)
    weights = [rng.normal(0, np.sqrt(2 / dim), (dim, width)), np.zeros(width), rng.normal(0, np.sqrt(1 / width), (width, parts)), np.zeros(parts)]
    speed = [np.zeros_like(w) for w in weights]
    x = rows * scale
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for chosen in (order[i: i + 64] for i in range(0, len(order), 64)):
            inner = np.maximum(x[chosen] @ weights[0] + weights[1], 0)
            logits = inner @ weights[2] + weights[3]
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), label[chosen]] -= 1
            error /= len(chosen)
            back = (error @ weights[2].T) * (inner > 0)
            for i, slope in enumerate((x[chosen].T @ back, back.sum(axis=0), inner.T @ error, error.sum(axis=0))):
                speed[i] = 0.9 * speed[i] - rate * slope
                weights[i] = weights[i] + speed[i]
    return Router(weights[0] * scale, weights[1], weights[2], weights[3], parts)


def fit_router(sample: np.ndarray, parts: int, k: int = NEIGHBOURS, recall: float = RECALL, seed: int = 3) -> Router:
    """Partitions of the sample's graph, the classifier, and the probes that reach the recall on the sample."""
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(sample, min(k, len(sample) - 1))
    router = _train(sample, balanced_parts(graph, parts, rng), parts, rng)
    # Judged with the filing that all rows get, by the classifier, not with the partitions learned from.
    filed = router.ranked(sample, 1)[:, 0]
    ranked = router.ranked(sample, parts)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(sample), 0), axis=1)
    depth = np.take_along_axis(place, filed[graph], axis=1).ravel()
    reached = np.cumsum(np.bincount(depth, minlength=parts)) / depth.size
    probes = int(np.searchsorted(reached, recall)) + 1
    return Router(router.hidden, router.hidden_bias, router.output, router.output_bias, min(parts, probes))


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact distances in double precision, scaled where squares would overflow or vanish."""
    apart = rows - query
    most = float(np.abs(apart).max()) if apart.size else 0.0
    if 1e-100 < most < 1e140 or most == 0:
        return np.sqrt((apart**2).sum(axis=1))
    scale = 2.0 ** -np.frexp(np.where(np.isfinite(most), most, 1.7e308))[1]
    return np.sqrt((((rows * scale) - (query * scale)) ** 2).sum(axis=1)) / scale


def _nearest(block: pa.Table, k: int) -> pa.Table:
    """The k nearest candidates of each query of a block by exact distance."""
    asking, queries = side(block, True)
    candidates, rows = side(block, False)
    at, places, scores = [], [], []
    if asking.num_rows and candidates.num_rows:
        numbers = candidates.column("number").to_numpy()
        own_numbers = asking.column("number").to_numpy()
        wide = max(float(np.abs(rows).max()), float(np.abs(queries).max())) > 1e140
        squares = (rows**2).sum(axis=1) if not wide else None
        for start in range(0, len(queries), 64):
            some = queries[start: start + 64]
            own = (some**2).sum(axis=1) if not wide else None
            far = own[:, None] + squares - 2 * some @ rows.T if not wide else None
            for i in range(len(some)):
                other = numbers != own_numbers[start + i]
                rough = np.where(other, _distances(rows, some[i]) if wide else far[i], np.inf)
                wanted = min(k, int(other.sum()))
                if not wanted:
                    continue
                # The product is off by rounding; whatever could be among the nearest is measured again.
                slack = 0.0 if wide else 1e-9 * (own[i] + squares.max())
                close = np.flatnonzero(other & (rough <= np.partition(rough, wanted - 1)[wanted - 1] + slack))
                exact = _distances(rows[close], some[i])
                kept = np.argsort(exact, kind="stable")[:wanted]
                at.append(start + i)
                places.append(close[kept])
                scores.append(exact[kept])
    return hits(asking, at, candidates, places, score=pa.array(joined(scores, np.float64)))


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = NEIGHBOURS,
            sample_rows: int = SAMPLE_ROWS, partition_rows: int = PARTITION_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id `every` divides, in all rows."""
    rows = clean_vectors(table, id_col, vector_col, zero=False)
    usual = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width, number = (usual["width"], usual["count"]) if usual else (0, 0)
    parts = 1
    while 2 * parts * partition_rows <= number and parts < MOST_PARTITIONS:
        parts *= 2
    router = None
    if parts > 1:
        drawn = rows.where((F.col("width") == width) & (uniform(F.lit(9), "number") < hashed_share(number, sample_rows)))
        drawn = drawn.orderBy("number").toArrow().column("vector")
        sample = np.unique(np.asarray(drawn.combine_chunks().flatten(), np.float64).reshape(-1, width), axis=0)
        router = fit_router(sample, parts, k, recall) if len(sample) > parts else None
    is_query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    kind = dict(rows.dtypes)["id"]

    def filed(batches):
        for batch in batches:
            own = batch.column("width").to_numpy() == width
            home = np.zeros(batch.num_rows, np.int32)
            probes = [[0]] * batch.num_rows
            if router is not None and own.any():
                ranked = router.ranked(vectors(batch.column("vector").filter(pa.array(own)), width), router.probes).astype(np.int32)
                home[own] = ranked[:, 0]
                for place, some in zip(np.flatnonzero(own), ranked.tolist()):
                    probes[place] = some
            asks = batch.column("asks").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(home, pa.int32()), pa.array([p if a else [] for p, a in zip(probes, asks)], pa.list_(pa.int32()))],
                ["number", "id", "vector", "width", "home", "probes"])

    marked = materialise(rows.select("number", "id", "vector", "width", is_query.alias("asks")).mapInArrow(
        filed, f"number long, id {kind}, vector array<double>, width int, home int, probes array<int>"), "ann-filed")
    candidates = marked.select("number", "id", "vector", "width", "home")
    queries = marked.where(F.size("probes") > 0).select("number", "id", "vector", "width", F.explode("probes").alias("home"))
    schema = f"query_number long, query_id {kind}, vec_number long, vec_id {kind}, score double"
    nearest_of = lambda block: _nearest(block, k)
    found = meet(candidates, queries, ["width", "home"], nearest_of, schema, BLOCK_ROWS, BLOCK_QUERIES)
    if router is None:
        return best(found, k, descending=False)
    # A query whose partitions hold fewer than k rows asks all of its width.
    found = materialise(found, "ann-found")
    reached = found.groupBy("query_number").agg(F.count(F.lit(1)).alias("reached")).where(F.col("reached") >= k)
    short = materialise(marked.where(F.size("probes") > 0).join(reached, F.col("number") == F.col("query_number"), "left_anti")
                        .where(F.col("width") == width).select("number", "id", "vector", "width"), "ann-short")
    if short.isEmpty():
        return best(found, k, descending=False)
    again = meet(candidates.drop("home"), short, ["width"], nearest_of, schema, BLOCK_ROWS, BLOCK_QUERIES)
    found = found.join(short.select(F.col("number").alias("query_number")), "query_number", "left_anti")
    return best(found.select(again.columns).unionByName(again), k, descending=False)
