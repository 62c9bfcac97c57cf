"""Which files can hold a symbol: a range and two bit maps per file.

An entry is of fixed size whatever the file holds: the smallest and the largest symbol, and two
bit maps of BITS bits with one bit per symbol in each, at places given by two hashes. A symbol
that lies outside the range, or whose bit is missing in a map, is not in the file; the other
way, a file may be named that lacks the symbol, never one left out that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a map, as `bitmap_construct_agg` makes them.
BITS = 32768
SEEDS = (11, 23)
ENTRY = ["folder", "file", "first_symbol", "last_symbol", *(f"bits_{seed}" for seed in SEEDS)]


def _place(symbol: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), symbol), F.lit(BITS))


def _bit(bits: Column, place: Column) -> Column:
    """Whether the bit at `place` is set: byte place / 8, lowest bit first."""
    byte = F.substring(bits, (F.floor(place / F.lit(8)) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % F.lit(8)).cast("int")) == 1


def file_entries(rows: DataFrame) -> DataFrame:
    """ENTRY of each file, from rows (folder, file, symbol); a file without symbols has no entry.

    One aggregate, combined before its shuffle: a task sends one entry per file it reads."""
    maps = [F.bitmap_construct_agg(_place(F.col("symbol"), seed)).alias(f"bits_{seed}") for seed in SEEDS]
    known = rows.filter(F.col("symbol").isNotNull())
    return known.groupBy("folder", "file").agg(F.min("symbol").alias("first_symbol"), F.max("symbol").alias("last_symbol"), *maps)


def can_hold(symbols: list[str]) -> Column:
    """Whether a file with these entry columns can hold any of the symbols."""
    def hit(symbol: Column) -> Column:
        held = (F.col("first_symbol") <= symbol) & (symbol <= F.col("last_symbol"))
        for seed in SEEDS:
            held = held & _bit(F.col(f"bits_{seed}"), _place(symbol, seed))
        return held

    return F.exists(F.array(*[F.lit(s) for s in symbols]).cast("array<string>"), hit)
