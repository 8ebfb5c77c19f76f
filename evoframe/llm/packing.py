"""Packing of tokenized documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import KEPT, lean
from evoframe.llm.pretokens import Words, gather

WINDOW = 2048
#: Bytes of text for each group that is packed alone; long texts have many pieces.
BYTES_PER_GROUP = 32 << 20
SPECIAL = "<|endoftext|>"
END_ID = 1
BLOCK = 1 << 19
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64())]
)
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities counts them, so the tightest fit is one descent."""

    def __init__(self, window: int) -> None:
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.stacks[capacity].append(window)
            self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        i, count = capacity + self.size, self.count
        while i:
            count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of at least `least`, removed; None if there is none."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not count[i]:
                    i += 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset for each length (each at most `window`), in the order given."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    number, offset, opened = [0] * len(lengths), [0] * len(lengths), 0
    free = OpenWindows(window)
    for i in order:
        n = lengths[i]
        found = free.take(n)
        capacity, w = found or (window, opened)
        opened += found is None
        number[i], offset[i] = w, window - capacity
        free.put(capacity - n, w)
    return number, offset


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def word_encoder(ranks: dict[bytes, int]):
    """Ids of one word, by tiktoken."""
    import tiktoken

    split_off = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return split_off.encode_ordinary


class Encoder:
    """Token ids of texts, as the tokenizers library gives them; a word is encoded once per worker.

    ranks holds the same vocabulary as merge ranks: words go through tiktoken's merges, which are several times
    faster; only a text with the special token's string goes through the library itself.
    """

    MOST = 150_000

    def __init__(self, vocabulary: str, ranks: str) -> None:
        self.vocabulary, self.library = vocabulary, None
        self.word = word_encoder(load_ranks(ranks))
        self.reset()

    def reset(self) -> None:
        self.words, self.flat, self.offsets = Words(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _grow(self) -> None:
        """Ids of the words that are new."""
        new = self.words.words[len(self.offsets) - 1 :]
        if not new:
            return
        ids = list(map(self.word, new))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.words.words) > self.MOST:
            self.reset()
        codes, counts = self.words.split(["" if SPECIAL in t else t for t in texts])
        self._grow()
        ids, sizes = gather(self.flat, self.offsets, codes)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        for k, t in enumerate(texts):
            if SPECIAL in t:
                yield self._by_library(t)
            else:
                yield ids[ends[k] : ends[k + 1]]


@cache
def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One for each Python worker, so that words stay known from task to task."""
    return Encoder(vocabulary, ranks)


KEPT[__name__] = encoder.cache_clear


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def tokenized_pieces(docs: DataFrame, vocabulary: str, ranks: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows cut from the front of a document, then its rest."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(vocabulary, ranks), TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _blocks(texts):
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                    raw, total = ids.astype("<u4").tobytes() + END_ID.to_bytes(4, "little"), len(ids) + 1
                    for start in range(0, total, window):
                        size = min(window, total - start)
                        out.append((doc_id, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), total, row))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES_SQL)


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, window: int = WINDOW, docs_per_group: int = 10_000) -> DataFrame:
    """Pieces of all documents with the window (sequence_id) and offset they are put at.

    A text of null or "" is the single closing id; equal documents, even with equal ids, are pieces of their own; an
    empty table gives no rows; further columns are ignored. Tokens never leave the task that made them: only
    piece lengths are dealt, by a hash of the row's place, to groups of about docs_per_group documents (fewer, if
    they are long), and each group is packed alone, so at most one window a group is left mostly empty.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-rows // docs_per_group), -(-(size or 0) // BYTES_PER_GROUP))

    def one_group(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        number, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = np.array(number, np.int64) * groups + int(key[0])
        pdf["offset"] = np.array(offset, np.int64)
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    pieces = tokenized_pieces(docs, vocabulary, ranks, window).withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return pieces.groupBy("g").applyInPandas(
        one_group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
