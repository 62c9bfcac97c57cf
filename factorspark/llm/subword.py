"""Averaged hashed subword embeddings with a linear softmax, trained by numpy SGD.

A text is its UTF-8 bytes through a folding table; its features are hashed n-grams of these
bytes and, if asked for, of words. Each feature has a learned vector; a text is the mean of
the vectors of all its features, and a linear layer with softmax gives the classes. As both
steps are linear, prediction needs one number per feature and class, so whole texts of any
length are scored by a table look-up. Work goes through fixed stretches of bytes, which
bounds memory whatever the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRETCH = 1 << 18
_R32 = np.uint32(2654435761)
_R64 = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """A-Z to lower case; every other ASCII character to a space; bytes of other letters stay."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table


def plain_table() -> np.ndarray:
    """ASCII white space to a space, digits to one digit, all else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[[9, 10, 11, 12, 13]] = 32
    table[48:58] = 48
    return table


@dataclass(frozen=True)
class Features:
    orders: tuple[int, ...]  # lengths of the byte n-grams
    words: bool              # also hashed words and pairs of words
    buckets: int             # a power of two
    table: np.ndarray

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        shift = np.uint32(32 - (self.buckets.bit_length() - 1))
        return ((hashes * _R32) >> shift).astype(np.int32)

    def grams(self, data: np.ndarray):
        """For each order: buckets of the n-grams that start at each byte but the last ones."""
        folded = self.table[data].astype(np.uint32)
        rolled = folded.copy()
        for order in range(1, max(self.orders, default=0) + 1):
            if order > 1:
                if len(folded) < order:
                    return
                rolled = rolled[:-1] * np.uint32(0x01000193) + folded[order - 1:]
            if order in self.orders:
                yield order, self._bucket(rolled + np.uint32(order * 0x3C6EF35F & 0xFFFFFFFF))

    def word_grams(self, data: np.ndarray, texts: np.ndarray):
        """(start, end, bucket) of words, pairs of words, and repeats of the word before; `texts` are where texts start."""
        inside = np.concatenate([[False], self.table[data] != 32, [False]])
        border = np.zeros(len(data) + 1, bool)
        border[texts] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.int32)
        powers, inverses = _powers(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum((self.table[data].astype(np.uint64) + np.uint64(1)) * powers)])
        hashes = (total[ends] - total[starts]) * inverses[starts]
        short = (hashes ^ (hashes >> np.uint64(29))).astype(np.uint32)
        pairs = (hashes[:-1] * _R64 ^ hashes[1:]) >> np.uint64(17)
        same = hashes[1:] == hashes[:-1]
        at = np.concatenate([starts, starts[:-1], starts[:-1][same]])
        to = np.concatenate([ends, ends[1:], ends[1:][same]])
        hashed = np.concatenate([short, pairs.astype(np.uint32), np.full(int(same.sum()), 77, np.uint32)])
        return at, to, self._bucket(hashed)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0x5851F42D4C957F2D
    full = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(count - 1, x, np.uint64), dtype=np.uint64)])
    return full(base), full(pow(base, -1, 1 << 64))


def _stretches(data: np.ndarray, offsets: np.ndarray, overlap: int):
    """Views of at most STRETCH bytes of one batch: (bytes, texts, first and last start inside).

    Several short texts share a view. A long text is cut; its views overlap so that each
    n-gram starts in exactly one of them.
    """
    first = 0
    count = len(offsets) - 1
    while first < count:
        if offsets[first + 1] - offsets[first] > STRETCH:
            for start in range(offsets[first], offsets[first + 1], STRETCH):
                own = min(start + STRETCH, offsets[first + 1])
                end = min(own + overlap, offsets[first + 1])
                yield data[start:end], np.array([first]), np.array([0]), np.array([own - start]), np.array([end - start])
            first += 1
            continue
        last = int(np.searchsorted(offsets, offsets[first] + STRETCH, "right")) - 1
        last = max(last, first + 1)
        base = offsets[first]
        starts, ends = offsets[first:last] - base, offsets[first + 1: last + 1] - base
        yield data[base: offsets[last]], np.arange(first, last), starts, ends, ends
        first = last


def counts(features: Features, data: np.ndarray, offsets: np.ndarray):
    """Per text of a batch: (distinct buckets, times). For training samples."""
    out = []
    for i in range(len(offsets) - 1):
        text = data[offsets[i]: offsets[i + 1]]
        total = np.zeros(features.buckets, np.int64)
        for part, _, _, own, end in _stretches(text, np.array([0, len(text)]), 64):
            for order, bucket in features.grams(part):
                total += np.bincount(bucket[: own[0]], minlength=features.buckets)
            if features.words:
                at, _, bucket = features.word_grams(part, np.zeros(1, int))
                total += np.bincount(bucket[at < own[0]], minlength=features.buckets)
        ids = np.flatnonzero(total)
        out.append((ids.astype(np.int32), total[ids].astype(np.float32)))
    return out


def scores(features: Features, table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the features' rows of `table`, number of features) of each text."""
    texts, classes = len(offsets) - 1, table.shape[1]
    sums, number = np.zeros((texts, classes)), np.zeros(texts, np.int64)
    for part, which, starts, own, ends in _stretches(data, offsets, 64):
        for order, bucket in features.grams(part):
            stop = np.minimum(own, ends - order + 1)
            some = stop > starts
            if not some.any():
                continue
            cuts = np.stack([starts[some], stop[some]], axis=1).ravel()
            for c in range(classes):
                running = np.concatenate([[0.0], np.cumsum(table[:, c][bucket], dtype=np.float64)])
                sums[which[some], c] += running[cuts[1::2]] - running[cuts[0::2]]
            number[which[some]] += (stop - starts)[some]
        if features.words:
            at, to, bucket = features.word_grams(part, starts)
            of = np.searchsorted(starts, at, "right") - 1
            fits = (to <= ends[of]) & (at < own[of])
            of, bucket = of[fits], bucket[fits]
            for c in range(classes):
                sums[which, c] += np.bincount(of, table[:, c][bucket], minlength=len(which))
            number[which] += np.bincount(of, minlength=len(which))
    return sums / np.maximum(number, 1)[:, None], number


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    features: Features
    classes: list
    table: np.ndarray       # one row per bucket, one column per class: embedding times output layer
    bias: np.ndarray
    temperature: float
    threshold: float        # calibrated probability below which a prediction is rejected

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated class probabilities, number of features) of each text."""
        means, number = scores(self.features, self.table, data, offsets)
        return softmax((means + self.bias) / self.temperature), number


def fit(features: Features, samples: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, dim: int = 12,
        epochs: int = 8, rate: float = 40.0, batch: int = 16, seed: int = 11, rejected: float = 0.001,
        least_steps: int = 1500) -> Model:
    """SGD over the samples; every fifth is held back to calibrate temperature and rejection.

    Classes weigh the same, however many samples each has; few samples are gone through more often."""
    kinds, y = np.unique(classes, return_inverse=True)
    weight_of = len(y) / (len(kinds) * np.bincount(y))
    rng = np.random.default_rng(seed)
    back = np.arange(len(samples)) % 5 == 4
    train = np.flatnonzero(~back if (~back).any() else back)
    embedding = rng.normal(0, 0.1, (features.buckets, dim)).astype(np.float32)
    layer = rng.normal(0, 0.3, (dim, len(kinds))).astype(np.float32)
    bias = np.zeros(len(kinds), np.float32)
    epochs = max(epochs, -(-least_steps * batch // max(1, len(train))))
    steps = max(1, epochs * -(-len(train) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for chosen in (order[i: i + batch] for i in range(0, len(order), batch)):
            size = rate * (1 - step / steps)
            step += 1
            parts = [samples[i] for i in chosen if len(samples[i][0])]
            labels = y[[i for i in chosen if len(samples[i][0])]]
            if not parts:
                continue
            weights = [p[1] / p[1].sum() for p in parts]
            hidden = np.stack([w @ embedding[p[0]] for p, w in zip(parts, weights)])
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(labels)), labels] -= 1
            error *= weight_of[labels][:, None]
            back_hidden = (error @ layer.T).astype(np.float32)
            layer -= (size / 100 / len(parts)) * (hidden.T @ error).astype(np.float32)
            bias -= (size / 400 / len(parts)) * error.sum(axis=0).astype(np.float32)
            for part, w, slope in zip(parts, weights, back_hidden):  # the buckets of one text are distinct
                embedding[part[0]] -= np.outer(w, (size / len(parts)) * slope)
    table = embedding @ layer
    held = [i for i in np.flatnonzero(back) if len(samples[i][0])]
    temperature, threshold = 1.0, 0.0
    if held:
        logits = np.stack([(table[samples[i][0]] * (samples[i][1] / samples[i][1].sum())[:, None]).sum(axis=0) for i in held]) + bias
        grid = np.geomspace(0.2, 8, 60)
        loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        sure = softmax(logits / temperature)
        right = sure[sure.argmax(axis=1) == y[held]].max(axis=1, initial=0)
        threshold = float(min(0.5, np.quantile(right, rejected))) if len(right) else 0.0
    return Model(features, kinds.tolist(), table.astype(np.float32), bias, temperature, threshold)
