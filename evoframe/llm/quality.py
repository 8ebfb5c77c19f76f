"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import checkpointed, lean, spans, text_bytes
from evoframe.llm.suffixes import Names

CUT = 0.7
SAMPLE_ROWS, PAIRS, BLOCK = 20_000, 100_000, 1 << 19

#: Byte classes; every byte is in exactly one.
CLASSES = ["\n", "\t\r\v\f", " ", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "'\"", "()[]{}", "-", "_", ";:", "@", "/\\", "=+", "<>", "~^`"]
LOWER, UPPER, DIGIT, LEAD, TAIL, CONTROL = range(len(CLASSES), len(CLASSES) + 6)
N_CLASSES = 32


def byte_classes() -> np.ndarray:
    out = np.full(256, CONTROL, np.uint8)
    for k, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = k
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    out[0xC0:], out[0x80:0xC0] = LEAD, TAIL
    return out


#: Class fractions, then: log length, word length, shares of words that begin upper-case, end in a symbol, repeat the last word or the one before.
N_FEATURES = N_CLASSES + 6


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text; an empty text has zeros."""
    table, n = byte_classes(), len(offsets) - 1
    sizes = np.diff(offsets)
    kind = table[data]
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    blank = kind <= 2
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][sizes > 0]] = True
    begin = before & ~blank
    end = np.zeros(len(data), bool)
    end[:-1] = begin[1:] | blank[1:]
    if len(data):
        end[offsets[1:][sizes > 0] - 1] = True
    end &= ~blank
    symbol = (kind >= 5) & (kind < LOWER)
    words = np.maximum(np.bincount(owner[begin], minlength=n), 1)
    upper = np.bincount(owner[begin & (kind == UPPER)], minlength=n) / words
    odd = np.bincount(owner[end & symbol], minlength=n) / words
    first, last, whose = np.flatnonzero(begin), np.flatnonzero(end), owner[begin]
    names = Names(data).of(first, last + 1)
    again = [np.bincount(whose[k:][(names[k:] == names[:-k]) & (whose[k:] == whose[:-k])], minlength=n) / words for k in (1, 2)]
    filled = np.maximum(sizes, 1)
    dense = (sizes - counts[:, :3].sum(1)) / words
    return np.column_stack([np.sqrt(counts / filled[:, None]), np.log1p(sizes), dense, upper, odd, *again])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every whole text; null counts as empty."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in spans(offsets, BLOCK):
                x = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, features array<float>")


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights w that make sigmoid(w . (better - worse)) likely over random preference pairs; Newton steps on the logistic loss."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * max(len(good), len(bad)))
    d = x[rng.choice(good, n)] - x[rng.choice(bad, n)]
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(len(w)), d.T @ (1 - p) / n - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """A linear score of standardized features, shifted so that the threshold has the probability CUT."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        if not len(x):
            x, y = np.zeros((1, N_FEATURES)), np.ones(1)
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = self._scaled(x)
        self.w = bradley_terry(z, y)
        s = np.sort(z @ self.w)
        low = int((y == 0).sum())  # as many of the learned rows fall below as have label 0
        self.threshold = float(s[0] - 1 if not low else s[-1] + 1 if low == len(s) else (s[low - 1] + s[low]) / 2)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self._scaled(x) @ self.w - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_rows(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, int]:
    """(doc_id, quality) of about sample_rows labelled documents (a bound, by hash of doc_id) that aren't held out, and how many; several labels of one doc_id: the lowest."""
    own = labels.where("quality is not null and doc_id is not null").where(~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample_rows / max(own.count(), 1))
    own = checkpointed(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), 2 * sample_rows // SAMPLE_ROWS)
    return own, own.count()


def fit(scored: DataFrame, rows: DataFrame, n: int) -> Model:
    """Learn from the features of these rows; they come to the driver, as many as learned_rows bounds."""
    one = scored.join(_side(rows, n), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    data = one.toPandas().sort_values("doc_id") if n else pd.DataFrame({"features": [], "quality": []})  # in one order, whatever the tasks
    x = np.stack(data["features"]).astype(np.float64) if len(data) else np.zeros((0, N_FEATURES))
    return Model(x, (data["quality"].to_numpy() > 0).astype(int) if len(data) else np.zeros(0))


def _side(rows: DataFrame, n: int) -> DataFrame:
    """Broadcast only as long as they are as few as the default sample."""
    return F.broadcast(rows) if n <= 2 * SAMPLE_ROWS else rows


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    A null text counts as empty and gets a score too; equal rows stay rows of their own; an empty table gives no rows;
    without labels of both kinds every document scores alike and is kept. Further columns are ignored.
    """
    scored = checkpointed(features(docs))
    model = fit(scored, *learned_rows(labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return scored.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns: the same model applied in place, so texts aren't shuffled."""
    rows, n = learned_rows(labels)
    model = fit(features(docs.select(F.col("doc_id").cast("long"), "text").join(_side(rows, n), "doc_id", "left_semi")), rows, n)

    @lean
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = text_bytes(texts)
        return pa.array(np.concatenate([np.zeros(0), *(model.score(text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float32).astype(np.float64)) for a, b in spans(offsets, BLOCK))]))

    return docs.where(F.arrow_udf(run, "double")(F.col("text")) >= CUT)
