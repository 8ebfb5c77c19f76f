"""Byte-level BPE: every distinct word of the corpus is encoded once, in a shuffle of words, and joined back by position."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import blob, checkpointed, groups_for, lean, unblob
from evoframe.llm.packing import load_ranks, word_encoder
from evoframe.llm.pretokens import Words, gather

#: Characters of text split at once, words of a block (then the next block begins), documents in one blob.
BLOCK, BLOCK_WORDS, BLOB_DOCS = 1 << 21, 600_000, 512
DOCS_PER_BUCKET = 4000
STEPS = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32()), ("print", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("payload", pa.binary())]
)
STEPS_SQL = "block long, bucket int, print long, doc_ids array<long>, counts array<int>, payload binary"


def _planes(codes: np.ndarray) -> bytes:
    """Little numbers by byte planes: frequent words have small numbers, so the upper planes are nearly empty."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def _unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(len(words).to_bytes(8, "little") + sizes.tobytes() + b"".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64) + 8 + 4 * n
    out, at = [], 8 + 4 * n
    for e in ends.tolist():
        out.append(raw[at:e])
        at = e
    return out



class _Block:
    """Words and positions of a run of documents of one task."""

    def __init__(self, block: int, buckets: int) -> None:
        self.block, self.buckets = block, buckets
        self.words, self.codes, self.counts, self.doc_ids = Words(), [], [], []

    def add(self, doc_ids: list, texts: list[str]) -> None:
        codes, counts = self.words.split(texts)
        self.codes.append(codes.astype(np.uint32))
        self.counts.append(counts)
        self.doc_ids += doc_ids

    def rows(self, part: str) -> Iterator[pa.RecordBatch]:
        """words: the words dealt to buckets by a hash of their bytes; documents: word numbers, which go by frequency, at all positions.

        Both carry a print of the block, so that rows of unlike evaluations of a table never meet unseen.
        """
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        words = [w.encode() for w in self.words.words]
        n = len(words)
        bucket = (np.fromiter(map(zlib.crc32, words), np.int64, n) % self.buckets).astype(np.int32)
        often = np.bincount(codes, minlength=n)
        by_use = np.argsort(-often, kind="stable")
        place = np.empty(n, np.uint32)
        place[by_use] = np.arange(n, dtype=np.uint32)
        own_print = zlib.crc32(codes, zlib.crc32(bucket))
        if part == "documents":
            ranked, ends = place[codes], np.append(0, np.cumsum(counts))
            for i in range(0, len(counts), BLOB_DOCS):
                j = min(len(counts), i + BLOB_DOCS)
                yield self._row(-1, own_print, self.doc_ids[i:j], counts[i:j].tolist(), _planes(ranked[ends[i] : ends[j]]))
            return
        order = by_use[np.argsort(bucket[by_use], kind="stable")]
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.unique(bucket).tolist():
            mine = order[edges[b] : edges[b + 1]]
            yield self._row(b, own_print, [], place[mine].tolist(), _pack_words([words[i] for i in mine.tolist()]))

    def _row(self, bucket: int, own_print: int, doc_ids: list, counts: list, payload: bytes) -> pa.RecordBatch:
        row = {"block": self.block, "bucket": bucket, "print": own_print, "doc_ids": doc_ids, "counts": counts, "payload": payload}
        return pa.RecordBatch.from_pylist([row], STEPS)


def positions(docs: DataFrame, buckets: int, part: str) -> DataFrame:
    """The pre-tokens of all documents with their positions, pre-aggregated in each task.

    part "words": distinct words of a block (payload) and their numbers (counts); part "documents": how many
    pre-tokens each document has, and the word number at every position. Each part splits the texts anew: that costs
    less than to keep the positions on disk until the words are encoded.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        block = _Block(number, buckets)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            i = size = 0
            for j in range(len(texts) + 1):
                if j == len(texts) or size + len(texts[j]) > BLOCK and j > i:
                    if j > i:
                        block.add(doc_ids[i:j], texts[i:j])
                    i, size = j, 0
                    if len(block.words.words) > BLOCK_WORDS:
                        yield from block.rows(part)
                        number += 1
                        block = _Block(number, buckets)
                size += len(texts[j]) if j < len(texts) else 0
        if block.doc_ids:
            yield from block.rows(part)

    return docs.mapInArrow(run, STEPS_SQL)


def encode_words(steps: DataFrame, ranks_path: str) -> DataFrame:
    """Each distinct word of a bucket is encoded once, whatever number of blocks hold it; its ids go back to those blocks."""

    @lean
    def run(t: pa.Table) -> pa.Table:
        word, seen, out = word_encoder(load_ranks(ranks_path)), {}, []
        for r in range(t.num_rows):
            ids, sizes = [], []
            for w in _unpack_words(t["payload"][r].as_py()):
                x = seen.get(w)
                if x is None:
                    x = seen[w] = word(w.decode())
                ids += x
                sizes.append(len(x))
            payload = blob(np.array(sizes, "<u4"), np.array(ids, "<u4"))
            out.append({"block": t["block"][r].as_py(), "bucket": t["bucket"][r].as_py(), "print": t["print"][r].as_py(), "doc_ids": [], "counts": t["counts"][r].as_py(), "payload": payload})
        return pa.Table.from_pylist(out, STEPS)

    return steps.groupBy("bucket").applyInArrow(run, STEPS_SQL)


def token_bytes(ranks_path: str) -> list[bytes]:
    """The token-byte table: fixed by the vocabulary file, whatever the corpus."""
    table = {i: b for b, i in load_ranks(ranks_path).items()}
    return [table.get(i, b"") for i in range(max(table) + 1)]


DIGEST_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED_SQL = "doc_id long, ids array<int>, decoded binary"


def encode_decode(docs: DataFrame, ranks: str | None = None, buckets: int | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded bytes) of every document; with digests, lengths and hashes of these instead.

    The table is read twice, which a table of files answers alike; one that comes from a shuffle is checkpointed first.
    A text of null or "" has no ids; equal rows, even with equal ids, stay rows of their own; an empty table gives
    no rows; further columns are ignored.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = checkpointed(docs)
    buckets = buckets or groups_for(docs, DOCS_PER_BUCKET)
    words = encode_words(positions(docs, buckets, "words"), ranks)

    @lean
    def together(docs_of: pa.Table, words_of: pa.Table) -> pa.Table:
        table, sizes_by, at, parts, total = token_bytes(ranks), [], [], [], 0
        if len({*docs_of["print"].to_pylist(), *words_of["print"].to_pylist()}) > 1:
            raise RuntimeError("the documents came in another order when they were read again; checkpoint them first")
        for r in range(words_of.num_rows):
            sizes, ids = unblob(words_of["payload"][r].as_py())
            sizes = sizes.astype(np.int64)
            at.append(words_of["counts"].chunk(0)[r].values.to_numpy() if words_of["counts"].num_chunks == 1 else np.array(words_of["counts"][r].as_py()))
            sizes_by.append(sizes)
            parts.append(ids)
            total += len(sizes)
        sizes, begin, flat = np.zeros(total, np.int64), np.zeros(total, np.int64), np.concatenate([np.zeros(0, np.uint32), *parts])
        base = 0
        for where, own, ids in zip(at, sizes_by, parts, strict=True):
            sizes[where] = own
            begin[where] = base + np.cumsum(own) - own
            base += len(ids)
        order_flat, _ = _lists(flat, begin, sizes)
        offsets = np.append(0, np.cumsum(sizes))
        listed = order_flat.tolist()
        names, raw = [], []
        if digests:
            text = [str(i) for i in range(len(table))]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                names.append(",".join([text[i] for i in listed[a:b]]))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw.append(b"".join([table[i] for i in listed[a:b]]))
        out: list[tuple] = []
        for r in range(docs_of.num_rows):
            codes, start = _unplanes(docs_of["payload"][r].as_py()).astype(np.int64), 0
            for doc_id, n in zip(docs_of["doc_ids"][r].as_py(), docs_of["counts"][r].as_py(), strict=True):
                own = codes[start : start + n]
                start += n
                words_here = own.tolist()
                decoded = b"".join([raw[c] for c in words_here])
                if digests:
                    joined = ",".join([names[c] for c in words_here]).encode()
                    out.append((doc_id, int(sizes[own].sum()), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    out.append((doc_id, gather(order_flat, offsets, own)[0].astype(np.int32).tolist(), decoded))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.binary()]
        named = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids", "decoded"]
        columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=named)

    return (
        positions(docs, buckets, "documents").groupBy("block").cogroup(words.groupBy("block"))
        .applyInArrow(together, DIGEST_SQL if digests else ENCODED_SQL)
    )


def _lists(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return flat[shift], sizes


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): each id is looked up in the token-byte table; bytes that are not UTF-8 become U+FFFD."""
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = token_bytes(ranks)
        for pdf in batches:
            texts = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
