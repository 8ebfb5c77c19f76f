"""Names (ranks) of byte strings, and the anchors at which strings of the threshold's length are compared."""

from __future__ import annotations

from functools import cache

import numpy as np

from evoframe.llm.common import GOLDEN, U64, mix, powers
from evoframe.llm.pretokens import BASE, INVERSE


@cache
def _byte_names(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U64) * GOLDEN + U64(seed))


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, n + 1), powers(INVERSE, n + 1)


def _sized(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 21
    while size < n:
        size *= 2
    return _tables(size)


class Names:
    """Names of any stretch of a byte array: equal stretches have equal names wherever they are."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        self.power, self.inverse = _sized(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_names(seed)[data] * self.power[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Names of the stretches of that length, at each position that has one."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost smallest value in each window of that width, by windows of doubled width.

    A value's low bits make room for its position, so that one minimum finds both; values that differ in these bits only count as
    equal. Positions fit in 24 bits: a block is at most that long, or its values are taken in pieces.
    """
    if len(x) >= 1 << 24:
        step = (1 << 24) - width
        return np.concatenate([leftmost_minima(x[a : a + step + width - 1], width) + a for a in range(0, len(x) - width + 1, step)])
    low, have = (x & ~U64(0xFFFFFF)) | np.arange(len(x), dtype=U64), 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return (low & U64(0xFFFFFF)).astype(np.int64)


def paired(rank: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The rank of strings whose two parts have these ranks, one step of doubling: equal pairs, and only they (but for a chance of 2**-64), have equal ranks."""
    with np.errstate(over="ignore"):
        return mix(mix(rank) + other * GOLDEN)


class Anchors:
    """Runs of neighbouring windows of `length` bytes that share an anchor: the least-ranked stretch of half that length in them.

    A window's anchor depends on its bytes alone, so equal windows meet at equal anchors. rank is the anchor's rank; context ranks
    the run's neighbourhood, all bytes of its windows together with their place around the anchor: the anchor stands between
    the two halves at its ends and touches both, so it is the pair of these halves' ranks, joined with the anchor's own.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        half = (length + 1) // 2
        self.apart, none = length - half, np.zeros(0, np.int64)
        self.first, self.last, self.owner, self.rank, self.context = none, none, none, none.astype(U64), none.astype(U64)
        if len(data) < length:
            return
        self.grams = grams = Names(data).every(half)
        at = leftmost_minima(grams, length - half + 1)
        valid = np.zeros(len(at) + 1, bool)
        sizes = np.diff(offsets)
        whole = sizes >= length
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, offsets[:-1][whole], 1)
        np.add.at(edge, offsets[1:][whole] - length + 1, -1)
        valid[:-1] = np.cumsum(edge)[: len(at)] > 0
        begin = valid[:-1].copy()
        begin[1:] &= (at[1:] != at[:-1]) | ~valid[:-2]
        end = valid[:-1].copy()
        end[:-1] &= begin[1:] | ~valid[1:-1]
        # A new text begins a run too, where one text's windows end right before the next one's.
        heads = offsets[:-1][whole]
        heads = heads[heads < len(at)]
        begin[heads] = True
        end[heads[heads > 0] - 1] &= valid[heads[heads > 0] - 1]
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end)
        anchor = at[self.first]
        self.rank = grams[anchor]
        with np.errstate(over="ignore"):
            place = ((anchor - self.first) * (2 * length) + (self.last - self.first)).astype(U64)
            self.context = mix(self.pairs(self.first, self.last + self.apart) + place * GOLDEN)
        self.owner = np.searchsorted(offsets, self.first, side="right") - 1

    def pairs(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Ranks of the strings that go from each place to the end of the half at the other one."""
        return paired(self.grams[at], self.grams[other])

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every window of these runs: its run (numbered in the order given) and where it starts."""
        size = self.last[runs] - self.first[runs] + 1
        run = np.repeat(np.arange(len(runs)), size)
        return run, self.first[runs][run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
