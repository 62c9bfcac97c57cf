"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids with an end mark; those longer than a sequence are cut. A
configuration is a multiset of lengths that fits a sequence. The program asks for the fewest
configurations that cover the histogram, whose size is bounded by the sequence length. It is
solved by multiplicative weights: each length has a price that falls as it is covered, a
knapsack table finds the configurations of the highest price, and each is used as often as its
pieces last, in whole sequences, so that no rounding is left over. It ends when those are
loose: what is left then, lengths that no longer combine, goes to best-fit in whole batches of equal sequences. The prices also give a lower bound on any
solution (`lower_bound`), hence the gap of the one found. Pieces of one length are numbered over the corpus from counts
per part, so each finds its sequence and offset by its number alone.

Defined results: a null or empty text is one piece that holds the end mark alone; a null id
is kept; repeated rows are packed each; extra columns are ignored; an empty table gives no
rows. No text is cut but at piece borders.
"""

from __future__ import annotations

import json
import math
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.runtime import materialise

CAPACITY = 2048
END = 0
ETA = 3.0
#: A configuration with less of the sequence filled ends the program.
TIGHT = 0.98
#: Configurations worth this share of the dearest are used in the same round.
NEAR = 0.98
CACHE = 300_000
#: Fixed value: how the vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The vocabulary is a byte-level BPE file of the `tokenizers` library, applied by the faster
    `tiktoken`, which gives the same ids (tested). A single space between two characters that
    are no white space always starts a token run, so the parts between such spaces are encoded
    on their own, and frequent ones kept. With `added`, strings of the file's added tokens become
    their ids, as the library has it by default; without, they are ordinary text, as it has it
    with `encode_special_tokens`. A text with a very long run of white space, on which the
    pattern would run out of stack, is left to the `tokenizers` library itself.
    """

    _SPACE = re.compile(r"(?<!\s) (?!\s)")
    _ODD = re.compile(r"[^\S \n]| [ \n]|\n ")
    _LONG = re.compile(r"\s{10000}")

    def __init__(self, path: str, added: bool = False) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        tokens = content.get("added_tokens", ())
        if any(t[kind] for t in tokens for kind in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        byte_of, special = _byte_of(), {t["content"] for t in tokens}
        self._added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens if added}
        # The longest is tried first.
        self._borders = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None
        ranks = {bytes(byte_of[c] for c in token): number for token, number in content["model"]["vocab"].items() if token not in special}
        self._path, self._library = path, None
        self._encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        found = self._ids(" " + part)
        if len(part) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[part] = found
        return found

    def _by_library(self, text: str) -> bytes:
        if self._library is None:
            self._library = tokenizers.Tokenizer.from_file(self._path)
            self._library.encode_special_tokens = not self._added
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) >= 10_000 and self._LONG.search(text):
            return self._by_library(text)
        out, at = [], 0
        for match in self._borders.finditer(text) if self._borders else ():
            out += (self._plain(text[at: match.start()]), self._added[match[0]])
            at = match.end()
        return b"".join((*out, self._plain(text[at:] if at else text)))

    def _plain(self, text: str) -> bytes:
        first, *rest = self._SPACE.split(text) if self._ODD.search(text) else text.split(" ")
        return self._ids(first) + b"".join(map(self.__getitem__, rest))


def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker. What is shipped by value has no lasting module of its own."""
    held = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path, added=True)
    return held[path]


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than a full one."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, place): place counts the pieces of one length inside a part."""
    source = docs.select(id_col, text_col)
    kind = dict(source.dtypes)[id_col]
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((row, piece, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            row, *columns = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 6))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:4]),
                 pa.array(np.full(len(row), part, np.int64)), pa.array(columns[4])],
                ["id", "piece", "start", "length", "ids_crc32", "part", "place"])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, place long"
    return materialise(source.mapInArrow(cut, schema), "pack-pieces")


class Knapsack:
    """The dearest multisets of lengths (rising) that fit each room."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int) -> None:
        self.lengths, self.prices = lengths, prices
        self.best, self.choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
        fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for room in range(1, capacity + 1):
            self.best[room] = self.best[room - 1]
            number = fitting[room]
            if number:
                values = self.best[room - lengths[:number]] + prices[:number]
                top = number - 1 - int(values[::-1].argmax())  # of equal values the longest piece
                if values[top] > self.best[room]:
                    self.best[room], self.choice[room] = values[top], top

    def starting(self, capacity: int, share: float) -> list[int]:
        """Places of the first pieces of the configurations that are worth `share` of the dearest, that one first."""
        values = self.prices + self.best[capacity - self.lengths]
        order = np.argsort(-values, kind="stable")
        return order[values[order] >= share * self.best[capacity]].tolist()

    def holding(self, first: int, capacity: int) -> dict[int, int]:
        """length -> pieces of the dearest configuration with this first piece."""
        found = {int(self.lengths[first]): 1}
        room = capacity - int(self.lengths[first])
        while room > 0:
            if self.choice[room] >= 0:
                length = int(self.lengths[self.choice[room]])
                found[length] = found.get(length, 0) + 1
                room -= length
            else:
                room -= 1
        return found


def _completed(times: dict[int, int], left: np.ndarray, there: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """(pieces, room) of a configuration without pieces that are used up, filled with the longest that fit."""
    times = {length: min(n, int(left[length - 1])) for length, n in times.items() if left[length - 1]}
    room = capacity - sum(length * n for length, n in times.items())
    at = int(np.searchsorted(there, room, "right")) - 1
    while at >= 0 and room > 0:
        length = int(there[at])
        more = min(room // length, int(left[length - 1]) - times.get(length, 0))
        if more > 0:
            times[length] = times.get(length, 0) + more
            room -= more * length
        at = min(at - 1, int(np.searchsorted(there, room, "right")) - 1)
    return times, room


def configurations(demand: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], np.ndarray, float]:
    """Tight configurations with whole amounts, the pieces of each length they leave, and a lower bound on the sequences.

    Each round prices the lengths anew and uses every configuration that is worth NEAR of the dearest, as often as its
    pieces last. The rounds end when none of these is tight; their number follows from the lengths, not from the pieces."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    full = int(left[capacity - 1])
    if full:  # a full piece has one configuration
        out.append(([capacity], full))
        left[capacity - 1] = 0
    total, bound, used = np.maximum(demand, 1).astype(float), 0.0, True
    while used and left.any():
        used = False
        there = np.flatnonzero(left) + 1
        prices = there * np.exp(-ETA * (1 - left[there - 1] / total[there - 1]))
        table = Knapsack(there, prices, capacity)
        if not bound:  # prices divided by the dearest configuration's are feasible for the dual program
            bound = float(left[there - 1] @ prices) / float(table.best[capacity])
        for first in table.starting(capacity, NEAR):
            if not left[there[first] - 1]:
                continue
            times, room = _completed(table.holding(first, capacity), left, there, capacity)
            if room > (1 - TIGHT) * capacity:
                continue
            amount = min(int(left[length - 1]) // n for length, n in times.items())
            for length, n in times.items():
                left[length - 1] -= amount * n
            out.append(([length for length in sorted(times, reverse=True) for _ in range(times[length])], amount))
            used = True
    return out, left, full + bound


def lower_bound(demand: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of the pieces has fewer sequences: the dual bound of the first prices, or all tokens by the capacity."""
    tokens = int(demand @ np.arange(1, capacity + 1))
    return max(-(-tokens // capacity), math.ceil(configurations(demand, capacity)[2] - 1e-6))


def solve(demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Configurations and whole amounts that cover the demand exactly."""
    out, left, _ = configurations(demand, capacity)
    # Best fit: the longest piece, then the longest that fits, repeated while the pieces last.
    there = np.flatnonzero(left) + 1
    while len(there):
        room, lengths, used = capacity, [], {}
        while True:
            at = int(np.searchsorted(there, room, "right")) - 1
            while at >= 0 and used.get(int(there[at]), 0) >= left[there[at] - 1]:
                at -= 1
            if at < 0:
                break
            length = int(there[at])
            lengths.append(length)
            used[length] = used.get(length, 0) + 1
            room -= length
        whole = min(int(left[length - 1]) // times for length, times in used.items())
        for length, times in used.items():
            left[length - 1] -= whole * times
        out.append((lengths, whole))
        there = there[left[there - 1] > 0]
    return out


def _runs(solution: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For each length and first place: sequence and offset of the pieces from there on."""
    rows, seen, sequence = [], {}, 0
    for lengths, amount in solution:
        offset = 0
        for length in lengths:
            first = seen.get(length, 0)
            rows.append(((length << 40) + first, sequence, offset))
            seen[length] = first + amount
            offset += length
        sequence += amount
    rows.sort()
    return tuple(np.array(column, np.int64) for column in (zip(*rows) if rows else [()] * 3))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = pieces(docs, path, id_col, text_col, capacity)
    per_part = materialise(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("rows")), "pack-counts")
    demand = np.zeros(capacity, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("rows").alias("rows")).collect():  # at most one row per length
        demand[row["length"] - 1] = row["rows"]
    keys, sequences, offsets = _runs(solve(demand, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    kind = dict(cut.dtypes)["id"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(5).to_numpy()
            key = (batch.column(3).to_numpy() << 40) + place
            run = np.searchsorted(keys, key, "right") - 1
            sequence = sequences[run] + key - keys[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offsets[run])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    located = cut.join(before, ["part", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("place"))
    done = located.mapInArrow(placed, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return done.withColumnRenamed("id", id_col)
