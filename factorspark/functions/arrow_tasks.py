"""The functions that run in Python workers, on Arrow columns.

They are shipped to the workers by value, so a cluster needs numpy, pandas and
pyarrow but not this package on its executors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MACD_COLUMNS = ["ema12", "ema26", "dif", "dea", "prev_dif", "prev_dea"]
MOMENT_COLUMNS = [
    "pair", "n", "mean_x", "mean_y", "sxx", "syy", "sxy", "min_x", "max_x", "min_y", "max_y",
]


def _averages(first: np.ndarray, price: np.ndarray) -> pd.DataFrame:
    """MACD_COLUMNS of whole symbols; `first` marks where one begins.

    The averages are recursive and seeded with the first value; a gap stays a gap but ages the past.
    """
    symbol = np.cumsum(first)

    def ema(values: np.ndarray, span: int) -> np.ndarray:
        smoothed = pd.Series(values).groupby(symbol).ewm(span=span, adjust=False, ignore_na=False).mean()
        return np.where(np.isnan(values), np.nan, smoothed.to_numpy())

    def shifted(values: np.ndarray) -> np.ndarray:
        return np.where(first, np.nan, np.concatenate(([np.nan], values[:-1])))

    fast, slow = ema(price, 12), ema(price, 26)
    dif = fast - slow
    dea = ema(dif, 9)
    return pd.DataFrame(dict(zip(MACD_COLUMNS, [fast, slow, dif, dea, shifted(dif), shifted(dea)])))


def macd_of_symbols(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Rows in order of (symbol, date): their place in the symbol and the price.

    A symbol whose rows may go on in the next batch waits for it.
    """
    places, prices = np.zeros(0, "int64"), np.zeros(0)
    for place, price in batches:
        places = np.concatenate([places, place.to_numpy("int64")])
        prices = np.concatenate([prices, price.to_numpy("float64")])
        starts = np.flatnonzero(places == 1)
        cut = starts[-1] if len(starts) else 0
        if cut:
            yield _averages(places[:cut] == 1, prices[:cut])
            places, prices = places[cut:], prices[cut:]
    if len(places):
        yield _averages(places == 1, prices)


def _days(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """Batches of rows sorted by (day, key), the place in the day first -> the columns of one whole day at a time."""
    waiting: list[tuple[pa.Array, ...]] = []

    def whole():
        return tuple(pa.concat_arrays(c) for c in zip(*waiting))

    for batch in batches:
        at = 0
        for start in np.flatnonzero(batch[0].to_numpy(zero_copy_only=False) == 1):
            if start > at:
                waiting.append(tuple(c[at:start] for c in batch))
            if waiting:
                yield whole()
            waiting, at = [], start
        if len(batch[0]) > at:
            waiting.append(tuple(c[at:] for c in batch))
    if waiting:
        yield whole()


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, which of them are not null); a NaN is a value, as in Spark the largest."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _mean_ranks(values: np.ndarray) -> np.ndarray:
    """1..n, equal values share their mean rank."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
    starts = np.flatnonzero(first)
    shared = (starts + 1 + np.append(starts[1:], len(values))) / 2.0
    ranks = np.empty(len(values))
    ranks[order] = shared[np.cumsum(first) - 1]
    return ranks


def _ordinals(values: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """1..n, equal values by `ties`, then in the order of the rows."""
    order = np.lexsort((*ties[::-1], values)) if ties else np.argsort(values, kind="stable")
    ranks = np.empty(len(values))
    ranks[order] = np.arange(1.0, len(values) + 1)
    return ranks


def mean_ranks_of_days(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """place in the day, whether the key of the row before comes again, values... ->
    per value its mean rank in the day (r0...) and the number of values (n0...).

    A key that comes more than once has the largest of its ranks.
    """
    for _, repeated, *columns in _days(batches):
        again = repeated.to_numpy(zero_copy_only=False)
        found: dict[str, pa.Array] = {}
        for i, column in enumerate(columns):
            values, held = _doubles(column)
            ranks = np.full(len(values), np.nan)
            ranks[held] = _mean_ranks(values[held])
            if again.any():
                ranks = np.fmax.reduceat(ranks, np.flatnonzero(~again))[np.cumsum(~again) - 1]
            found[f"r{i}"] = pa.array(ranks, pa.float64(), mask=np.isnan(ranks))
            found[f"n{i}"] = pa.array(np.full(len(values), held.sum(), "int64"))
        yield pa.StructArray.from_arrays([found[f"{c}{i}"] for c in "rn" for i in range(len(columns))],
                                         names=[f"{c}{i}" for c in "rn" for i in range(len(columns))])


def _pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    if x.min() == x.max() or y.min() == y.max():
        return None
    x, y = x - x.mean(), y - y.mean()
    spread = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
    return None if spread == 0 else float((x * y).sum() / spread)


def day_figures(factors: list[str], fewest: int, ic: bool, groups: int | None):
    """Whole days (place, again, day, return, factors...) -> per factor its correlations and the return sums of its groups."""
    kinds = {"factor": pa.string(), "trade_date": pa.date32(), "group": pa.int64(), "sample_count": pa.int64(),
             "ic": pa.float64(), "rank_ic": pa.float64(), "return_sum": pa.float64()}

    def of_factor(values, returns, key):
        n = len(values)
        if ic and n >= fewest:
            places = _ordinals(values)
            # a key that comes twice has one return: its rows follow each other as their values do
            ties = (key, places) if (key[1:] == key[:-1]).any() else ()
            yield None, n, _pearson(values, returns), _pearson(places, _ordinals(returns, *ties)), None
        if groups and n:
            share = np.floor((_mean_ranks(values) - 1.0) / n * groups)
            group = np.clip(share, 0, groups - 1).astype("int64")
            counts, sums = np.bincount(group, minlength=groups), np.bincount(group, returns, minlength=groups)
            yield from ((g, int(counts[g]), None, None, float(sums[g])) for g in np.flatnonzero(counts).tolist())

    def run(batches):
        with np.errstate(all="ignore"):
            for _, again, day, returned, *columns in _days(tuple(b.columns) for b in batches):
                returns, _ = _doubles(returned)
                key = np.cumsum(~again.to_numpy(zero_copy_only=False))
                rows = []
                for factor, column in zip(factors, columns):
                    values, held = _doubles(column)
                    rows += [(factor, day[0].as_py(), *row) for row in of_factor(values[held], returns[held], key[held])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    return run


def pair_moments(columns: list[str]):
    """Batches -> one row per column pair with counts, means and centred sums.

    Rows where either side is missing are left out of a pair. Batches of a partition
    are combined here, so a partition sends len(pairs) rows however long it is.
    """
    first, second = np.triu_indices(len(columns))

    def of_batch(x):
        held = ~np.isnan(x)
        both = held[:, first] & held[:, second]
        n = both.sum(axis=0).astype("float64")
        a, b = np.where(both, x[:, first], 0.0), np.where(both, x[:, second], 0.0)
        safe = np.maximum(n, 1.0)
        mean_x, mean_y = a.sum(axis=0) / safe, b.sum(axis=0) / safe
        dx, dy = np.where(both, a - mean_x, 0.0), np.where(both, b - mean_y, 0.0)
        edges = [
            reduced
            for v in (a, b)
            for reduced in (np.where(both, v, np.inf).min(axis=0), np.where(both, v, -np.inf).max(axis=0))
        ]
        return [n, mean_x, mean_y, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0), *edges]

    def combined(p, q):
        n = p[0] + q[0]
        share = q[0] / np.maximum(n, 1.0)
        gap_x, gap_y = q[1] - p[1], q[2] - p[2]
        weight = p[0] * share
        return [
            n, p[1] + gap_x * share, p[2] + gap_y * share,
            p[3] + q[3] + gap_x * gap_x * weight, p[4] + q[4] + gap_y * gap_y * weight,
            p[5] + q[5] + gap_x * gap_y * weight,
            np.minimum(p[6], q[6]), np.maximum(p[7], q[7]), np.minimum(p[8], q[8]), np.maximum(p[9], q[9]),
        ]

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.column_stack([
                batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(len(columns))
            ])
            part = of_batch(x)
            total = part if total is None else combined(total, part)
        if total is not None:
            filled = total[0] > 0
            data = [np.arange(len(first))[filled]] + [v[filled] for v in total]
            types = [pa.int32()] + [pa.float64()] * len(total)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, types)], names=MOMENT_COLUMNS)

    return run
