"""SimHash near-duplicates: fingerprints linked by sharded vantage-point trees.

Equal fingerprints form one class first. Of two fingerprints with at most three differing
bits, one 32-bit half differs in at most one bit. So there is a tree for each half, and a
fingerprint is looked up there within distance 1. A node of a tree has a vantage point and a
radius: what lies within goes inside, the rest outside. By the triangle inequality a search
needs a side only if its distance to the vantage point, changed by the search distance,
reaches that side. The driver builds two trees of at most ROOT_LEAVES leaves from at most
ROOT_SAMPLE fingerprints, whatever the corpus; their leaves are the shards. Each fingerprint
lives in one shard of each tree and visits the others that its ball overlaps, where the side
within searches for nothing outside, so that each pair meets once. Shards that hold many rows
get a tree of their own, built by a task from a sample of theirs of the same bound, and their
rows are routed on in chunks, until a shard is small or no tree divides it. Shards compare
exactly, and give only a spanning forest of their links.

Where many fingerprints share a half, a node measures all 64 bits instead and searches within
distance 3.

Defined results: a null or wordless text has fingerprint zero and is linked like any other;
a null id is never a smallest id unless all of a component's are null; repeated rows are
reported each; extra columns are ignored or, in `one_of_each`, kept; an empty table gives no
rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.runtime import materialise
from .common import hashed_share, numbered, private, uniform
from .components import components

WORDS = 3
SEED = 42
REACH = 3
LEAF_ROWS = 4096
SAMPLE_PER_LEAF = 16
ROOT_LEAVES = 1024
ROOT_SAMPLE = ROOT_LEAVES * SAMPLE_PER_LEAF
LARGE = 4  # a shard of more than this many times the rows of a leaf is routed on
CHUNK_ROWS = 8192
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text over XXH64 of its shingles, repeats included."""
    found = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    number = len(found) - words + 1
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype(">u8"), number)
    set_bits = np.zeros(64, np.int64)
    for start in range(0, number, 1 << 15):
        set_bits += np.unpackbits(hashes[start: start + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > number).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, name: str, words: int = WORDS) -> DataFrame:
    """The rows with their fingerprint as a signed long in `name`."""
    at, columns = docs.columns.index(text_col), docs.columns

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*columns, name])

    return docs.mapInArrow(marked, StructType([*docs.schema.fields, StructField(name, LongType())]))


class Tree:
    """A vantage-point tree whose leaves are numbered. Nodes: (mask, point, radius, reach, inside, outside)."""

    def __init__(self, mask: np.uint64, sample: np.ndarray, leaves: int, rng: np.random.Generator) -> None:
        self.mask, self.nodes, self.leaves = mask, [], 0
        self.root = self._build(np.unique(sample), max(1, leaves), rng)

    def _build(self, sample: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        split = self._split(sample, rng) if leaves > 1 and len(sample) > 1 else None
        if split is None:
            self.nodes.append(self.leaves)
            self.leaves += 1
            return len(self.nodes) - 1
        mask, point, radius, reach = split
        within = np.bitwise_count((sample ^ point) & mask) <= radius
        own = len(self.nodes)
        self.nodes.append(None)
        share = min(leaves - 1, max(1, round(leaves * float(within.mean()))))
        inside = self._build(sample[within], share, rng)
        outside = self._build(sample[~within], leaves - share, rng)
        self.nodes[own] = (mask, point, radius, reach, inside, outside)
        return own

    def _split(self, sample: np.ndarray, rng: np.random.Generator):
        """Of some vantage points the one that divides best for the copies it makes."""
        best, found = np.inf, None
        tries = np.concatenate([rng.choice(sample, min(12, len(sample)), replace=False), rng.integers(0, 2**64, 4, np.uint64)])
        for mask, reach in ((self.mask, 1 if self.mask != WHOLE else REACH), (WHOLE, REACH)):
            for point in tries:
                far = np.bitwise_count((sample ^ point) & mask).astype(np.int64)
                middle = int(np.median(far))
                for radius in (middle - 1, middle):
                    inside = float((far <= radius).mean())
                    if not 0 < inside < 1:
                        continue
                    visits = float(((far <= radius + reach).mean() + (far > radius - reach).mean()))
                    cost = np.log(visits) / -np.log(max(inside, 1 - inside))
                    if cost < best:
                        best, found = cost, (mask, point, radius, reach)
            if best < 0.9:
                break
        return found

    def packed(self) -> bytes:
        """The nodes alone, which a task reads without this class."""
        return pickle.dumps((self.mask, self.nodes, self.leaves, self.root))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.mask, tree.nodes, tree.leaves, tree.root = pickle.loads(data)
        return tree

    def route(self, prints: np.ndarray, lives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it lives there) of every stay and visit.

        Rows that only visit the whole tree visit every leaf that their ball overlaps."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(prints)), lives)]
        while todo:
            at, rows, lives = todo.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if not isinstance(node, tuple):
                out.append((rows, np.full(len(rows), node), lives))
                continue
            mask, point, radius, reach, inside, outside = node
            far = np.bitwise_count((prints[rows] ^ point) & mask).astype(np.int64)
            near = far <= radius + reach  # those that live outside visit within; not the other way
            todo.append((inside, rows[near], lives[near] & (far[near] <= radius)))
            other = np.where(lives, far > radius, far > radius - reach)
            todo.append((outside, rows[other], lives[other]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(bool)
        return tuple(np.concatenate(part) for part in zip(*out))


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union by smallest index: `root` holds for each row the index of its group."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _shard_links(prints: np.ndarray, lives: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a shard: of those that live there with all in it."""
    order = np.argsort(~lives, kind="stable")
    prints, home = prints[order], int(lives.sum())
    root = np.arange(len(prints))
    block = max(1, min(512, (1 << 22) // max(1, len(prints))))
    for start in range(0, home, block):
        stop = min(home, start + block)
        near = np.bitwise_count(prints[start:stop, None] ^ prints[None, start:]) <= reach
        a, b = np.nonzero(near)
        a, b = a + start, b + start
        other = a < b
        root = _merge(root, a[other], b[other])
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


STAY = "half int, shard long, parent_rows long, print long, lives boolean"


def _stays(own: np.ndarray, rows: np.ndarray, lives: np.ndarray, half: int, shard: np.ndarray, parent_rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), half, np.int32)), pa.array(shard.astype(np.int64)),
         pa.array(np.full(len(rows), parent_rows, np.int64)), pa.array(own[rows].view(np.int64)), pa.array(lives)],
        ["half", "shard", "parent_rows", "print", "lives"])


def _first_stays(prints: DataFrame, leaf_rows: int, root_leaves: int) -> DataFrame:
    """The rows STAY of the shards of two trees that the driver builds from a sample of fixed size."""
    number = prints.count()
    leaves = min(root_leaves, -(-number // leaf_rows))
    sample = prints.where(uniform(F.lit(1), "print") < hashed_share(number, leaves * SAMPLE_PER_LEAF)).select("print")
    drawn = np.sort(np.asarray(sample.limit(2 * ROOT_SAMPLE).toArrow().column(0).to_numpy(), np.int64)).view(np.uint64)
    rng = np.random.default_rng(5)
    trees = [Tree(mask, drawn, leaves, rng) for mask in (HALVES if leaves > 1 else (WHOLE,))]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for half, tree in enumerate(trees):
                rows, leaf, lives = tree.route(own, np.ones(len(own), bool))
                yield _stays(own, rows, lives, half, leaf, number)

    return prints.select("print").mapInArrow(routed, STAY)


def _routed_on(large: DataFrame, masks: tuple, leaf_rows: int) -> DataFrame:
    """The rows STAY of large shards, with their counted `rows_`, in the shards of a tree for each of these.

    A tree is built from a sample of at most about ROOT_SAMPLE rows; the rows go through in chunks of
    bounded size, so that no task holds a shard."""
    leaves = F.least(F.lit(ROOT_LEAVES), F.ceil(F.col("rows_") / F.lit(leaf_rows)))
    drawn = large.where(uniform(F.lit(2), "shard", "print") < leaves * F.lit(SAMPLE_PER_LEAF) / F.col("rows_"))

    def built(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        half, shard, rows = key
        rng = np.random.default_rng(shard & 0x7FFFFFFF)
        tree = Tree(masks[half], sample["print"].to_numpy().view(np.uint64), min(ROOT_LEAVES, -(-rows // leaf_rows)), rng)
        return pd.DataFrame({"half": [half], "shard": [shard], "tree": [tree.packed()]})

    trees = drawn.groupBy("half", "shard", "rows_").applyInPandas(built, "half int, shard long, tree binary")
    chunk = F.floor(uniform(F.lit(3), "print") * F.ceil(F.col("rows_") / F.lit(CHUNK_ROWS)))
    chunks = large.groupBy("half", "shard", "rows_", chunk.alias("chunk_")).agg(
        F.collect_list("print").alias("prints"), F.collect_list("lives").alias("lives"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                half, shard, count, prints, lives, tree = (column[row] for column in batch.columns)
                half, shard = half.as_py(), shard.as_py()
                own = prints.values.to_numpy().view(np.uint64)
                home = lives.values.to_numpy(zero_copy_only=False)
                # A shard too small to be drawn from stays one.
                whole = Tree.unpacked(tree.as_py()) if tree.is_valid else Tree(masks[half], own[:0], 1, np.random.default_rng(0))
                rows, leaf, stays = whole.route(own, home)
                names = np.array([xxhash.xxh64_intdigest(f"{shard}:{i}") for i in range(whole.leaves)], np.uint64).view(np.int64)
                yield _stays(own, rows, stays, half, names[leaf], count.as_py())

    return (
        chunks.join(trees, ["half", "shard"], "left").select("half", "shard", "rows_", "prints", "lives", "tree")
        .mapInArrow(routed, STAY))


def links(prints: DataFrame, reach: int = REACH, leaf_rows: int = LEAF_ROWS, root_leaves: int = ROOT_LEAVES) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `print` at most `reach` bits apart."""
    stays = materialise(_first_stays(prints, leaf_rows, root_leaves), "simhash-stays")
    done = []
    while True:
        # A shard of more than three quarters of the rows it came from is not divided again: so this ends.
        sizes = stays.groupBy("half", "shard", "parent_rows").agg(F.count(F.lit(1)).alias("rows_"))
        again = sizes.where((F.col("rows_") > LARGE * leaf_rows) & (F.col("rows_") <= 0.75 * F.col("parent_rows")))
        again = materialise(again.select("half", "shard", "rows_"), "simhash-large")
        if again.isEmpty():
            done.append(stays)
            break
        done.append(stays.join(again, ["half", "shard"], "left_anti"))
        stays = materialise(_routed_on(stays.join(again, ["half", "shard"]), HALVES, leaf_rows), "simhash-stays")

    def linked(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        a, b = _shard_links(shard["print"].to_numpy().view(np.uint64), shard["lives"].to_numpy(bool), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    columns = ["half", "shard", "print", "lives"]
    whole = done[0].select(columns)
    for part in done[1:]:
        whole = whole.unionByName(part.select(columns))
    return whole.groupBy("half", "shard").applyInPandas(linked, "a long, b long")


def _grouped(marked: DataFrame, reach: int, leaf_rows: int) -> DataFrame:
    """(print, component, group_) of each distinct fingerprint of rows (id, print).

    The component is the smallest id, the group a fingerprint, which also tells components without ids apart."""
    classes = materialise(marked.groupBy("print").agg(F.min("id").alias("first_id")), "simhash-classes")
    roots = materialise(components(links(classes, reach, leaf_rows), "simhash-edges"), "simhash-roots")
    first = (
        roots.join(classes, roots.node == classes["print"]).groupBy("root").agg(F.min("first_id").alias("smallest")))
    of = roots.join(first, "root").select("node", "root", "smallest")
    return materialise(
        classes.join(of, classes["print"] == of.node, "left")
        .select("print", F.when(F.col("node").isNotNull(), F.col("smallest")).otherwise(F.col("first_id")).alias("component"),
                F.coalesce("root", "print").alias("group_")), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
                    leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = materialise(fingerprints(source, "text", "print").select("id", "print"), "simhash-rows")
    of = _grouped(marked, reach, leaf_rows)
    return marked.join(of, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
                leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Of every group of near copies the document with the smallest id, unchanged."""
    print_, number = private(docs, "print_", "row_number_")
    rows = numbered(fingerprints(docs, text_col, print_), "simhash-documents", number)
    marked = rows.select(F.col(id_col).alias("id"), F.col(print_).alias("print"), F.col(number).alias("number"))
    grouped = marked.join(_grouped(marked, reach, leaf_rows), "print")
    # A null id comes last; the row number settles repeated ids.
    first = grouped.groupBy("group_").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first"))
    return rows.join(first.select(F.col("first.number").alias(number)), number, "left_semi").select(*docs.columns)
