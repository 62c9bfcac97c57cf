"""Searches, clusters and hard negatives over vectors against brute force on Python's numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factorspark.llm import ann_search, block_search, centroid_clusters, hard_negatives, topk_search

SCHEMA = "vec_id long, embedding array<double>, label int, number int, query_ int, score double, width string"
REST = (7, 1, 0.5, "w")


def vector_rows():
    """Uniform rows, one vector that many share, and rows that are odd in every way."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).round(2).tolist(), int(rng.integers(0, 4))) for i in range(3000)]
    rows += [(i, rows[100][1], 2) for i in range(3000, 3400)]
    rows += [(4000, None, 1), (4100, [0.0] * 8, 1), (4200, [None] + [1.0] * 7, 1), (4300, [float("nan")] * 8, 1),
             (4400, [float("inf")] * 8, 1), (4500, [1.0] * 3, 1), (4501, [2.0, -1.0, 0.5], 1), (4502, [2.0, 2.0, 2.0], 0),
             (None, [1.0] * 8, 1), (None, [1.0] * 8, 1), (100, rows[100][1], 1), (100, [0.25] * 8, 1), (7, [0.5] * 8, 3),
             (4600, [], 1), (4601, [], 0), (4602, [], 1), (4700, [1e6] * 8, 2), (4701, [1e6 + 0.5] * 8, 2), (4800, [-3e30] * 8, 1), (4801, [2e30] * 8, 1),
             (4802, [-2.9e30] * 8, 0), (4900, [1.0] * 8, None)]
    return [(*row, *REST) for row in rows]


def floor(x, scale):
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def usable(rows, scale=None, zero=True):
    """[(id, vector, label)] of the rows that take part."""
    out = []
    for i, v, label, *_ in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        out.append((i, [floor(x, scale) for x in v] if scale else v, label))
    return out


def shown(score):
    return max(-(2**63), min(2**63 - 1, score))


def last(i):
    return (i is None, i or 0)


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), SCHEMA)


@pytest.mark.parametrize("block_rows", [65536, 300])
def test_top_k_equals_all_products(vectors, block_rows):
    rows = usable(vector_rows(), 1024)
    wanted = Counter()
    for at, (query, vector, _) in enumerate(rows):
        if query is not None and query % 100 == 0:
            scores = [(-product(vector, v), last(i), i) for place, (i, v, _) in enumerate(rows) if place != at and len(v) == len(vector)]
            wanted.update((query, rank, i, shown(-score)) for rank, (score, _, i) in enumerate(sorted(scores)[:10], 1))
    assert Counter(map(tuple, topk_search.top_k(vectors, block_rows=block_rows, block_queries=7).collect())) == wanted


def test_components_of_any_size_are_exact(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [70000.0]), (2, [90000.0]), (3, [-1e200])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(table).orderBy("rank").collect()] == [
        (0, 1, 2, 94371840000), (0, 2, 1, 73400320000), (0, 3, 3, -(2**63))]


@given(st.lists(st.integers(-(2**200), 2**200), min_size=1))
@settings(max_examples=60, deadline=None)
def test_stored_scores_keep_their_order(numbers):
    numbers += [2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 0]
    score, beyond = block_search.stored(np.array(numbers + [0], object)[:-1])
    pairs = list(zip(score.to_pylist(), beyond.to_pylist()))
    assert [hard_negatives.limit_of(*pair) for pair in pairs] == numbers
    assert [n for _, n in sorted(zip(pairs, numbers))] == sorted(numbers)


def test_probed_partitions_hold_the_neighbours(vectors):
    rows = usable(vector_rows(), zero=False)
    known = defaultdict(set)
    for i, v, _ in rows:
        known[i].add(tuple(v))
    found = defaultdict(list)
    for r in ann_search.nearest(vectors, partition_rows=256).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for at, (query, vector, _) in enumerate(rows):
        if query is None or query % 100:
            continue
        far = sorted((math.dist(v, vector), last(i), i) for place, (i, v, _) in enumerate(rows) if place != at and len(v) == len(vector))[:10]
        if len(known[query]) > 1:
            continue  # two rows ask under one id
        got = sorted(found[query])
        assert [g[0] for g in got] == list(range(1, len(far) + 1))
        assert [g[2] for g in got] == sorted(g[2] for g in got)
        hit += len(Counter(f[2] for f in far) & Counter(g[1] for g in got))
        total += len(far)
    assert hit / total >= 0.9
    assert len(found[100]) == 30  # three rows of that id ask each
    assert [(g[1], g[2]) for g in sorted(found[4500])] == [(4502, pytest.approx(math.sqrt(3))), (4501, pytest.approx(math.sqrt(5.25)))]
    assert 4100 not in found and 4600 not in found


def test_searches_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann_search.nearest(table).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert [tuple(r) for r in topk_search.top_k(table).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 512 * 1024)]
    for search in (ann_search.nearest, topk_search.top_k):
        assert search(table.limit(0)).count() == 0 and search(table.where("vec_id = 0")).count() == 0


def plain_negatives(rows, relabel=True):
    rows = [(i, v, (label + 1) % 10 if relabel and i is not None and i % 7 == 0 else label) for i, v, label in rows if label is not None]
    out = Counter()
    for at, (anchor, vector, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = sorted((-product(vector, v), last(i), i, other) for place, (i, v, other) in enumerate(rows) if place != at and len(v) == len(vector))
        for p, _, positive, _ in [s for s in scored if s[3] == label][:5]:
            fitting = [(n, i) for n, _, i, other in scored if other != label and 80 * -p <= 100 * -n <= 100 * -p]
            out.update((anchor, positive, rank, i, shown(-p), shown(-n)) for rank, (n, i) in enumerate(fitting[:5], 1))
    return out


@pytest.mark.parametrize("block_rows", [65536, 300])
def test_hard_negatives_equal_all_products(vectors, block_rows):
    got = hard_negatives.mine(vectors, relabel=hard_negatives.next_of_ten, block_rows=block_rows, block_queries=7)
    wanted = plain_negatives(usable(vector_rows(), 256))
    assert len(wanted) > 100 and Counter(map(tuple, got.collect())) == wanted


def test_hard_negatives_of_ties_and_labels_of_text(spark):
    rows = [(0, [1.0], "a")] + [(i, [1.0], "a") for i in range(1, 8)] + [(i, [0.9], "b") for i in range(10, 30)] + [(40, [1.1], "c"), (41, [0.8], "c"), (42, [0.79], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = Counter(map(tuple, hard_negatives.mine(table).collect()))
    assert got == Counter((0, p, r, n, 256 * 256, 256 * 230) for p in range(1, 6) for r, n in enumerate(range(10, 15), 1))
    assert hard_negatives.mine(table.limit(0)).count() == 0
    assert hard_negatives.mine(table.where("vec_id <> 0")).count() == 0  # no anchor
    assert hard_negatives.mine(table.where("label <> 'a' OR vec_id = 0")).count() == 0  # no positive


@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.lists(st.integers(0, 30), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_slots_answer_all_windows(scores, limits):
    limits = sorted(set(limits), reverse=True)
    places, slots, firsts = hard_negatives.slot_best(np.array(scores, np.float64), limits, 3, 80)
    for window, limit in enumerate(limits):
        falling = sorted((s, -scores[p], p) for p, s, f in zip(places, slots, firsts) if s >= window and f <= window)
        inside = sorted((-s, p) for p, s in enumerate(scores) if 80 * limit <= 100 * s <= 100 * limit)
        assert [(s, p) for _, s, p in falling][:3] == inside[:3]


def plain_clusters(rows, clusters, rounds):
    """{(id, cluster, distance): times} and the final centroids; rows are [(id, floors, vector)]."""
    named = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    centroids = [r[1] for r in named[:clusters]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), number) for number, c in enumerate(centroids)) for _, v, _ in rows]

    for _ in range(rounds):
        found = assign()
        for number in range(len(centroids)):
            mine = [v for (_, v, _), (_, n) in zip(rows, found) if n == number]
            if mine:
                centroids[number] = [sum(c) // len(mine) for c in zip(*mine)]
    return assign(), centroids


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_equal_plain_rounds(spark, wide):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist(), 0, *REST) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], 0, *REST) for i in range(400, 500)]  # many copies, among them first centroids
    rows += [(500, None, 0, *REST), (501, [1.0] * 3, 0, *REST), (502, [None, 1.0, 1.0, 1.0], 0, *REST), (None, [0.1] * 4, 0, *REST),
             (3, [9.0] * 4, 0, *REST), (503, [float("inf")] * 4, 0, *REST)]
    if wide:
        rows += [(600, [1e6] * 4, 0, *REST), (601, [-1e25, 1.0, 2.0, 3.0], 0, *REST), (602, [3e40, 1.0, 2.0, 3.0], 0, *REST)]
    kept = [(i, [floor(x, 256) for x in v], v) for i, v, *_ in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = centroid_clusters.report(table, clusters=15, width=4).collect()
    found, centroids = plain_clusters(kept, 15, 5)
    of = defaultdict(int)
    for distance, number in found:
        of[number] += distance
    limit = 2**63 - 1
    wanted = Counter(
        (i, number, min(d, limit), min(of[number], limit), min(sum(of.values()), limit), hashlib.sha256(",".join(map(str, centroids[number])).encode()).hexdigest())
        for (i, *_), (d, number) in zip(kept, found))
    assert Counter(map(tuple, got)) == wanted


def test_clusters_of_few_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in centroid_clusters.report(table, width=2).collect()}
    assert got[1]["cluster"] == got[2]["cluster"] != got[3]["cluster"] and {r["distance"] for r in got.values()} == {0}
    assert centroid_clusters.report(table.limit(0), width=2).count() == 0
    assert centroid_clusters.report(table, width=9).count() == 0


@given(st.integers(1, 60), st.integers(0, 2**32), st.sampled_from([3, 40, 2**35, 2**90]))
@settings(max_examples=60, deadline=None)
def test_the_tree_finds_the_nearest_and_settles_ties(number, seed, spread):
    rng = np.random.default_rng(seed)
    unit = max(1, spread // 40)
    draw = lambda n: np.array([[int(x) * unit for x in row] for row in rng.integers(-min(spread, 40), min(spread, 40) + 1, (n, 3))], object)
    centroids, rows = draw(number), draw(50)
    if spread < 2**60:
        centroids, rows = centroids.astype(np.int64), rows.astype(np.int64)
    cluster, distance = centroid_clusters.CentroidTree(centroids).nearest(rows)
    wanted = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(r, c)), n) for n, c in enumerate(centroids)) for r in rows]
    assert [(int(d), int(c)) for d, c in zip(distance, cluster)] == wanted
