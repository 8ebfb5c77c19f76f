"""Sets of word shingles, named by 64-bit hashes, for whole blocks of texts."""

from __future__ import annotations

import numpy as np

from evoframe.llm.common import GOLDEN, M1, U64, mix
from evoframe.llm.suffixes import Names

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words (runs of other bytes than blanks, A-Z lower-cased) of all texts in a row, and how many each text has."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n, np.int64)
    low = _LOWER[data]
    word = ~_BLANK[low]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    sizes = np.diff(offsets)
    heads, tails = offsets[:-1][sizes > 0], offsets[1:][sizes > 0] - 1
    begin[heads], end[tails] = word[heads], word[tails]
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    counts = np.diff(np.searchsorted(first, offsets))
    return Names(low, seed=5).of(first, last + 1), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text in ascending order, one text after the other, and the size of each set.

    A text of fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    names, counts = word_names(data, offsets)
    n, ends = len(counts), np.cumsum(counts)
    with np.errstate(over="ignore"):
        many = max(0, len(names) - words + 1)
        value = np.zeros(many, U64)
        for k in range(words):
            value = value * M1 + names[k : k + many]
        value = mix(value + U64(words) * GOLDEN)
        owner = np.repeat(np.arange(n), counts)
        fits = owner[:many] == owner[words - 1 :] if many else np.zeros(0, bool)
        value, owner = value[fits], owner[:many][fits]
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            whole = np.zeros(len(short), U64)
            for k in range(words - 1):
                has = counts[short] > k
                whole[has] = whole[has] * M1 + names[(ends - counts)[short[has]] + k]
            value = np.concatenate([value, mix(whole + counts[short].astype(U64) * GOLDEN)])
            owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=n)
