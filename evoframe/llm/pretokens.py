"""The splitting pattern of byte-level BPE, evaluated on whole blocks of text at once.

The pattern's alternatives only look at character classes (letter, number, white space, other), a single
leading blank and seven contractions, so token starts follow from neighbouring classes. A text with a
code point that this Python's tables don't know goes through the regular expression itself.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import regex

from evoframe.llm.common import GOLDEN, U64, mix, powers

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: White space as Unicode's White_Space property has it.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def classes() -> np.ndarray:
    out = np.empty(0x110000, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    for i in range(0x110000):
        c = category(chr(i))
        out[i] = UNKNOWN if c == "Cn" else kind.get(c[0], OTHER)
    out[WHITE] = SPACE
    return out


@cache
def _names() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(0x110000, dtype=U64) + GOLDEN)


@cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@cache
def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, n), powers(INVERSE, n)


def weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    while size < n:
        size *= 2
    return _weights(size)


def starts(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a match of the pattern begins. first: where a text begins."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    change = first.copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 32
    blank_before &= ~first
    word_next = np.zeros(n, bool)
    word_next[:-1] = ~space[1:] & ~first[1:]
    out = np.where(space, change | word_next, change & ~blank_before)
    quote = np.flatnonzero((points == 39) & out)
    if len(quote):
        ends = np.append(np.flatnonzero(first), n)
        end = ends[np.searchsorted(ends, quote, side="right")]
        one = np.where(quote + 1 < end, points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < end, points[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        hit = size > 0
        quote, after, end = quote[hit], (quote + size)[hit], end[hit]
        out[quote + 1] = False
        after = after[after < end]
        out[after[kinds[after] == LETTER]] = True
    return out


class Words:
    """Numbers for the distinct words of a run of blocks, in the order of their first place."""

    def __init__(self) -> None:
        self.code: dict[int, int] = {}
        self.words: list[str] = []

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word number of each token of all texts in a row, and how many tokens each text has."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        first = np.zeros(len(points), bool)
        first[begin[sizes > 0]] = True
        kinds = classes()[points]
        at = np.flatnonzero(starts(points, first, kinds))
        odd = np.flatnonzero(kinds == UNKNOWN)
        if len(odd):
            owner = np.unique(np.searchsorted(begin, odd, side="right") - 1)
            at = self._exact(texts, owner, begin, sizes, at)
        stop = np.append(at[1:], len(points))
        power, inverse = weights(len(points))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(points) + 1, U64)
            np.cumsum(_names()[points] * power[: len(points)], out=sums[1:])
            keys = mix((sums[stop] - sums[at]) * inverse[at] + (stop - at).astype(U64) * GOLDEN)
        local, unique = pd.factorize(keys)
        where = np.empty(len(unique), np.int64)
        where[local[::-1]] = np.arange(len(keys) - 1, -1, -1)
        known = self.code
        table = np.empty(len(unique), np.int64)
        names = unique.tolist()
        table[:] = list(map(known.get, names, repeat(-1)))
        fresh = np.flatnonzero(table < 0)
        for k, a, b in zip(fresh.tolist(), at[where[fresh]].tolist(), stop[where[fresh]].tolist(), strict=True):
            table[k] = known[names[k]] = len(self.words)
            self.words.append(joined[a:b])
        counts = np.diff(np.searchsorted(at, np.append(begin, len(points))))
        return table[local], counts

    @staticmethod
    def _exact(texts, owner, begin, sizes, at) -> np.ndarray:
        keep = np.ones(len(at), bool)
        more = []
        for d in owner.tolist():
            keep[np.searchsorted(at, begin[d]) : np.searchsorted(at, begin[d] + sizes[d])] = False
            more.append(begin[d] + np.fromiter((m.start() for m in pattern().finditer(texts[d])), np.int64))
        return np.sort(np.concatenate([at[keep], *more]))


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists flat[offsets[c]:offsets[c + 1]] of all codes in a row, and their lengths."""
    sizes = (offsets[1:] - offsets[:-1])[codes]
    total = int(sizes.sum())
    shift = np.repeat(offsets[codes] - (np.cumsum(sizes) - sizes), sizes)
    shift += np.arange(total)
    return flat[shift], sizes
