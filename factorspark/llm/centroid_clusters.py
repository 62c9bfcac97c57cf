"""Centroid clustering with a vantage-point tree over the centroids.

Every round builds a vantage-point tree of the centroids, whose number is a parameter, and ships
it to the tasks. A node holds a vantage centroid and two halves of the others, each with the
least and the greatest distance from the vantage point; a leaf holds a few centroids. Each
vector searches best first: of its open nodes it takes the one with the least lower bound that
the triangle inequality gives, measures the centroids there exactly, in whole numbers, and opens
the halves. A node is left out only if its bound is beyond the distance found so far; a bound
that equals it is followed, as a tie goes to the smaller number. The vectors of a batch take
their steps together, each with its own queue.

Tasks reduce their vectors to one line per centroid (count, component sums); Spark adds these
lines up exactly, wide sums in limbs. New centroids are the floors of sum by count.

Defined results: only vectors of `width` components, none null or non-finite, take part;
repeated ids are rows of their own; a row with a null id takes part and starts no cluster unless
there are too few others; fewer rows than clusters give fewer clusters; equal first vectors
leave the larger number empty, and empty centroids stay; numbers of any size are exact, and a
distance or inertia beyond 64 bits is shown as the largest 64-bit number; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import materialise
from .block_search import clean_vectors, whole

SCALE = 256
CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
SEED = 2
LEAF = 4
BATCH = 8192
_LONG = (1 << 63) - 1
_BITS = 31


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances; the caller has chosen a type that holds them."""
    apart = rows - point
    return (apart * apart).sum(axis=1)


class CentroidTree:
    """A vantage-point tree. Nodes: (vantage, inside, outside) or, for a leaf, (centroids,); each has its distances
    (least, greatest) from the vantage point above it."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids, self.leaf = centroids, leaf
        self.exact = centroids.astype(object)
        self.nodes: list[tuple] = []
        self.reach: list[tuple[int, int]] = []  # floor of the least, ceiling of the greatest distance from the parent's vantage point
        self._build(np.arange(len(centroids)), (0, 0))

    def _build(self, members: np.ndarray, reach: tuple[int, int]) -> int:
        at = len(self.nodes)
        self.nodes.append((members,))
        self.reach.append(reach)
        if len(members) <= self.leaf:
            return at
        # The vantage point is the member with the widest spread of distances to the others.
        far = [squared(self.exact[members], self.exact[m]) for m in members]
        spread = [int(max(f)) - int(min(g for g, m in zip(f, members) if m != own)) for f, own in zip(far, members)]
        chosen = int(np.argmax(np.array(spread, object)))
        rest = np.arange(len(members)) != chosen
        others, distances = members[rest], far[chosen][rest]
        order = np.argsort(distances, kind="stable")
        halves = order[: len(order) // 2], order[len(order) // 2:]
        sides = []
        for half in halves:
            least, greatest = distances[half].min(), distances[half].max()
            sides.append(self._build(others[half], (math.isqrt(least), math.isqrt(greatest) + 1)))
        self.nodes[at] = (int(members[chosen]), *sides)
        return at

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row, ties to the smaller number."""
        most = max((abs(int(x)) for part in (rows, self.centroids) if part.size for x in (part.max(), part.min())), default=0)
        furthest = rows.shape[1] * (2 * most) ** 2
        kind = np.int64 if furthest < 1 << 62 else object
        rows, centroids = rows.astype(kind), self.centroids.astype(kind)
        # Bounds are doubles: of roots, or of whole roots without their last bits, and a little lower than true.
        shift = max(0, most.bit_length() - 200)
        loose = 0.0 if kind is np.int64 else 2.0
        root = (lambda d: np.sqrt(d.astype(np.float64))) if kind is np.int64 else (
            lambda d: np.array([float(math.isqrt(x) >> shift) for x in d.tolist()]))
        best = np.full(len(rows), -1, np.int64)
        found = np.full(len(rows), furthest + 1, kind)
        bounds = np.full((len(rows), len(self.nodes)), np.inf)  # of the open nodes of each row; infinite: not open
        bounds[:, 0] = 0.0
        open_ = np.arange(len(rows))
        while len(open_):
            node = bounds[open_].argmin(axis=1)
            follow = bounds[open_, node] <= root(found[open_]) + loose  # inclusive: a tie may wait at the bound
            open_, node = open_[follow], node[follow]
            bounds[open_, node] = np.inf
            for at in np.unique(node):
                some = open_[node == at]
                vantage, *sides = self.nodes[at]
                if not sides:
                    for centroid in vantage:
                        self._measure(rows, some, centroids, int(centroid), best, found)
                    continue
                away = root(self._measure(rows, some, centroids, vantage, best, found))
                for side in sides:
                    least, greatest = (float(x >> shift) for x in self.reach[side])
                    lower = np.maximum(away - greatest, least - away)
                    bounds[some, side] = np.maximum(0.0, lower - 1e-9 * (away + greatest) - loose)
            open_ = open_[np.isfinite(bounds[open_].min(axis=1))]
        return best, found

    @staticmethod
    def _measure(rows, some, centroids, number, best, found) -> np.ndarray:
        distance = squared(rows[some], centroids[number])
        nearer = (distance < found[some]) | ((distance == found[some]) & (number < best[some]))
        best[some[nearer]] = number
        found[some[nearer]] = distance[nearer]
        return distance


def first_centroids(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The floors of the vectors with the smallest hash of seed and id; at most `clusters` rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    taken = rows.orderBy(name.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return whole(np.array([r["vector"] for r in taken], np.float64).reshape(len(taken), -1 if taken else 0), scale)


def _matrix(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """The floors of column `vector` of a batch that has rows."""
    flat = np.asarray(batch.column("vector").flatten(), np.float64)
    return whole(flat.reshape(batch.num_rows, -1), scale)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def moved(rows: DataFrame, centroids: np.ndarray, limbs: int, scale: int) -> np.ndarray:
    """The centroids after one round."""
    clusters, width = centroids.shape
    tree = CentroidTree(centroids)
    low = (1 << _BITS) - 1

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, width + 1), object)  # Python's numbers; the first is the count
        for batch in _sliced(batches):
            values = _matrix(batch, scale)
            cluster, _ = tree.nearest(values)
            for number in np.unique(cluster):
                mine = values[cluster == number]
                fits = mine.dtype != object and int(max(abs(int(mine.max())), abs(int(mine.min())))) * len(mine) < 1 << 62
                total = mine.sum(axis=0) if fits else mine.astype(object).sum(axis=0)
                sums[number] += np.array([len(mine), *(int(x) for x in total)], object)
        used = [number for number in range(clusters) if sums[number][0]]
        parts = []
        for number in used:
            line = []
            for value in sums[number]:
                for _ in range(limbs - 1):
                    line.append(int(value) & low)
                    value = int(value) >> _BITS
                line.append(int(value))
            parts.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["cluster", "parts"])

    lines = rows.select("vector").mapInArrow(reduced, "cluster int, parts array<long>")
    # At most one row for each centroid, component and limb.
    added = lines.select("cluster", F.posexplode("parts")).groupBy("cluster", "pos").agg(F.sum("col").alias("value")).collect()
    sums = np.zeros((clusters, width + 1), object)
    for row in added:
        sums[row["cluster"], row["pos"] // limbs] += row["value"] << (_BITS * (row["pos"] % limbs))
    new = np.array([[x // line[0] for x in line[1:]] if line[0] else old for line, old in zip(sums.tolist(), centroids.tolist())], object)
    new = new.reshape(clusters, width)
    return new.astype(np.int64) if all(abs(x) < 1 << 62 for x in new.ravel().tolist()) else new


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            width: int = WIDTH, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = clean_vectors(table, id_col, vector_col, zero=True).where(F.col("width") == width)
    kind = dict(rows.dtypes)["id"]
    centroids = first_centroids(rows, clusters, seed, scale)
    if len(centroids):
        facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
        limbs = -(-((scale * (int(facts["most"]) + 1)) * facts["rows"]).bit_length() // _BITS)
        for _ in range(rounds):
            new = moved(rows, centroids, limbs, scale)
            if (new == centroids).all():  # the other rounds would change nothing either
                break
            centroids = new
    tree = CentroidTree(centroids) if len(centroids) else None

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            number, distance = tree.nearest(_matrix(batch, scale))
            shown = distance if distance.dtype != object else np.array([min(int(d), _LONG) for d in distance.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(number.astype(np.int32)), pa.array(shown, pa.int64())], ["id", "cluster", "distance"])

    found = rows.select("id", "vector").mapInArrow(assigned, f"id {kind}, cluster int, distance long")
    return materialise(found, "cluster-rows"), centroids


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def report(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """Every vector with its cluster, the inertia of that and of all, and a hash of its centroid."""
    found, centroids = cluster(table, id_col, vector_col, **settings)
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    of = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(exact.alias("inertia")).collect()}  # one row per centroid
    whole_inertia = min(sum(of.values()), _LONG)
    figures = found.sparkSession.createDataFrame(
        [(number, min(inertia, _LONG), whole_inertia, digest(centroids[number])) for number, inertia in sorted(of.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as there are centroids.
    return found.withColumnRenamed("id", id_col).join(F.broadcast(figures), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
