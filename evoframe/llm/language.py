"""Language identification: a bidirectional gated recurrent network over the bytes of a text, in numpy.

The network runs on through a text in both directions, across words, digits and marks, and labels every byte position; a document's
probabilities are the mean over its positions. A long text is run in segments side by side, each with a run-in of its own
neighbouring bytes on both sides, so memory doesn't depend on its length and every position has a context of at least
the run-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm.common import checkpointed, lean
from evoframe.llm.quality import is_held_out

#: Hidden units a direction; bytes that a segment labels, and that it runs in before them and after.
HIDDEN, SEGMENT, RUN_IN = 12, 1024, 64
#: Learned from at most so many crops of so many bytes of each of so many documents a language.
DOCS_PER_LANG, CROPS, CROP = 300, 12, 64
BATCH, UPDATES = 256, 400
UNKNOWN = "und"
#: Up to so many chosen documents their ids are broadcast; beyond (thousands of languages), they are joined in a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text prepared at once, and positions of a batch (fewer where more than four numbers of each are kept).
BLOCK, POSITIONS = 1 << 21, 1 << 21
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps x sequences; padding is 256) and their mask."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.full((len(texts), int(sizes.max(initial=0))), 256, np.int64)
    mask = np.arange(x.shape[1])[None, :] < sizes[:, None]
    x[mask] = np.frombuffer(b"".join(texts), np.uint8)
    return x.T.copy(), mask.T.astype(np.float32)


class BiGru:
    """Every byte position is labelled from both directions' states; a padding step leaves the state as it was."""

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 3) -> None:
        rng, h = np.random.default_rng(seed), hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(h)).astype(np.float32)
        self.h = h
        self.p = {"out": draw(2 * h, labels), "bias": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": draw(257, 3 * h), f"{d}g": draw(h, 2 * h), f"{d}c": draw(h, h)}

    def _step(self, d: str, into: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Update gate, reset gate and candidate."""
        h = self.h
        gates = _sigmoid(into[:, : 2 * h] + state @ self.p[f"{d}g"])
        z, r = gates[:, :h], gates[:, h:]
        return z, r, np.tanh(into[:, 2 * h :] + (r * state) @ self.p[f"{d}c"])

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        state, out, tape = np.zeros((x.shape[1], self.h), self.p["out"].dtype), np.zeros((*x.shape, self.h), self.p["out"].dtype), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z, r, c = self._step(d, self.p[f"{d}x"][x[t]], state)
            z = z * mask[t][:, None]
            tape.append((t, state, z, r, c))
            state = state + z * (c - state)
            out[t] = state
        return out, tape

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions, and its gradients by backpropagation through time."""
        h = self.h
        f, tape_f = self._run("f", x, mask)
        b, tape_b = self._run("b", x, mask)
        both = np.concatenate([f, b], 2)
        p = _softmax(both @ self.p["out"] + self.p["bias"])
        total, at = mask.sum(), (slice(None), np.arange(x.shape[1]), y)
        loss = float(-(np.log(p[at] + 1e-9) * mask).sum() / total)
        p[at] -= 1
        p *= mask[:, :, None] / total
        g = {"out": np.tensordot(both, p, ((0, 1), (0, 1))), "bias": p.sum((0, 1))}
        back = p @ self.p["out"].T
        symbols = np.arange(257)
        order = np.argsort(x, axis=None, kind="stable")
        begin = np.searchsorted(x.ravel()[order], symbols)
        some = np.append(begin[1:], x.size) > begin
        for d, tape, part in (("f", tape_f, back[:, :, :h]), ("b", tape_b, back[:, :, h:])):
            wg, wc = self.p[f"{d}g"], self.p[f"{d}c"]
            gx, gg, gc = np.zeros_like(self.p[f"{d}x"]), np.zeros_like(wg), np.zeros_like(wc)
            into = np.zeros((*x.shape, 3 * h), wg.dtype)
            ds = np.zeros((x.shape[1], h), wg.dtype)
            for t, state, z, r, c in reversed(tape):
                ds = ds + part[t]
                dz, dc = ds * (c - state), ds * z * (1 - c * c)
                drs = dc @ wc.T
                dgates = np.concatenate([dz * z * (1 - z), drs * state * r * (1 - r)], 1)
                into[t, :, : 2 * h], into[t, :, 2 * h :] = dgates, dc
                gg += state.T @ dgates
                gc += (r * state).T @ dc
                ds = ds * (1 - z) + drs * r + dgates @ wg.T
            gx[some] = np.add.reduceat(into.reshape(-1, 3 * h)[order], begin[some], axis=0)
            g |= {f"{d}x": gx, f"{d}g": gg, f"{d}c": gc}
        return loss, g

    def train(self, crops: list[bytes], y: np.ndarray, updates: int = UPDATES, seed: int = 5) -> None:
        """Adam with a falling rate."""
        x, mask = padded(crops)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, updates + 1):
            pick = rng.integers(0, x.shape[1], BATCH)
            _, g = self.gradients(x[:, pick], mask[:, pick], y[pick])
            rate = 0.03 * (1 - i / (updates + 1))
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of the position probabilities from low to high, of sequences from start to stop that are run side by side.

        Longest first: at every step the sequences that still (or, from the end, already) go on are the first ones.
        """
        size = stop - start
        order = np.argsort(-size, kind="stable")
        start, size, low, high = start[order], size[order], (low - start)[order], (high - start)[order]
        steps, n, h = int(size[0]), len(size), self.h
        active = np.searchsorted(-size, -np.arange(steps), side="left").tolist()  # sequences longer than t
        x = data[np.minimum(start[None, :] + np.arange(steps)[:, None], len(data) - 1)]
        labels = len(self.p["bias"])
        few = labels < h  # then what the output takes from the forward states is kept instead of them
        forward, sums = np.empty((steps, labels, n) if few else (steps, n, h), np.float32), np.zeros((labels, n), np.float32)
        wf, wb, bias = self.p["out"][:h].T.copy(), self.p["out"][h:].T.copy(), self.p["bias"][:, None]
        state, step = np.zeros((n, h), np.float32), self._stepper("f", n)
        for t in range(steps):
            k = active[t]
            step(x[t, :k], state[:k])
            if few:
                np.matmul(wf, state[:k].T, out=forward[t, :, :k])
            else:
                forward[t, :k] = state[:k]
        state[:] = 0
        step = self._stepper("b", n)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            step(x[t, :k], state[:k])
            e = wb @ state[:k].T
            e += forward[t, :, :k] if few else wf @ forward[t, :k].T
            e += bias
            np.minimum(e, 60, out=e)
            np.exp(e, out=e)
            e *= ((t >= low[:k]) & (t < high[:k])) / e.sum(0)
            sums[:, :k] += e
        out = np.empty((n, len(sums)), np.float32)
        out[order] = sums.T
        return out

    def _stepper(self, d: str, n: int) -> Callable[[np.ndarray, np.ndarray], None]:
        """_step and the update of up to n states in place, without padding: each gate in an array of its own, whose rows lie together.

        A gate is half of 1 + tanh; the halves are in the weights, which powers of two leave exact.
        """
        h, half = self.h, np.float32(0.5)
        tables = [np.ascontiguousarray(w) for w in np.split(self.p[f"{d}x"], 3, 1)]
        tables[0], tables[1] = tables[0] * half, tables[1] * half
        wz, wr, wc = self.p[f"{d}g"][:, :h] * half, self.p[f"{d}g"][:, h:] * half, self.p[f"{d}c"] * half
        into, kept = np.empty((n, h), np.float32), [np.empty((n, h), np.float32) for _ in range(3)]

        def step(x: np.ndarray, state: np.ndarray) -> None:
            k = len(x)
            i, (z, r, c) = into[:k], (w[:k] for w in kept)
            for gate, w, table in ((z, wz, tables[0]), (r, wr, tables[1])):
                np.matmul(state, w, out=gate)
                np.take(table, x, 0, out=i, mode="clip")
                gate += i
                np.tanh(gate, out=gate)
                gate += 1
            r *= state
            np.matmul(r, wc, out=c)
            np.take(tables[2], x, 0, out=i, mode="clip")
            c += i
            np.tanh(c, out=c)
            c -= state
            c *= half
            c *= z
            state += c

        return step

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for an empty one."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        first, last = (ends - sizes)[owner], ends[owner]
        low = first + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
        high = np.minimum(low + SEGMENT, last)
        start, stop = np.maximum(low - RUN_IN, first), np.minimum(high + RUN_IN, last)
        out = np.zeros((len(texts), len(self.p["bias"])))
        by = np.argsort(stop - start, kind="stable")[::-1]
        a = 0
        while a < len(by):
            own = by[a : a + max(1, 4 * POSITIONS // max(4, min(self.h, len(self.p["bias"]))) // int((stop - start)[by[a]]))]
            np.add.at(out, owner[own], self.pooled(data, start[own], stop[own], low[own], high[own]))
            a += len(own)
        return out / np.maximum(sizes, 1)[:, None]


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> tuple[list[str], BiGru | None]:
    """Learn from crops of at most docs_per_lang documents a language (by hash of doc_id) that aren't held out; only crops come to the driver."""
    own = docs.where("text is not null and lang is not null").where(~is_held_out()).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.length("text"))
    ids = own.select("doc_id", "lang", F.length("text").alias("n"), F.row_number().over(order).alias("k")).where(F.col("k") <= docs_per_lang)
    ids = checkpointed(ids.select("doc_id", "lang").distinct())
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    @lean
    def crops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = normal(text)
                # Evenly over the whole text.
                at = np.unique(np.linspace(0, max(0, len(raw) - CROP), CROPS).astype(int)).tolist()
                own = [raw[a : a + CROP] for a in at if LETTER.search(raw[a : a + CROP].decode("utf-8", "ignore"))]
                langs += [lang] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "crop"])

    chosen = own.join(side, ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = sorted(chosen.mapInArrow(crops, "lang string, crop binary").toPandas().itertuples(index=False), key=lambda r: (r.lang, r.crop))
    langs = sorted({r.lang for r in rows})
    if not rows:
        return langs, None
    number = {lang: k for k, lang in enumerate(langs)}
    # As many of each language, so that none is preferred for being frequent.
    y, rng = np.array([number[r.lang] for r in rows]), np.random.default_rng(1)
    most = np.bincount(y).max()
    pick = np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == k)), most) for k in range(len(langs))])
    model = BiGru(len(langs))
    model.train([rows[i].crop for i in pick.tolist()], y[pick])
    return langs, model


def predict(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    A text of null, "" or without a letter is `und` with score 0, and so is every text if nothing could be learned.
    Equal rows stay rows of their own; an empty table gives no rows; further columns are ignored.
    """
    langs, model = fit(docs, docs_per_lang)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, i, size = batch.column(1), 0, 0
            n = pa.compute.binary_length(texts).fill_null(0).to_pylist()
            for j in range(len(n) + 1):
                if j < len(n) and (size + n[j] <= BLOCK or i == j):
                    size += n[j]
                    continue
                if j > i:
                    own = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                    known = [model is not None and LETTER.search(t) is not None for t in own]
                    p = model.score([normal(t) if k else b"" for t, k in zip(own, known, strict=True)]) if model else np.zeros((j - i, 1))
                    best = p.argmax(1)
                    names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.minimum(p.max(1), 1.0))], ["doc_id", "lang_pred", "score"])
                i, size = j, n[j] if j < len(n) else 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", is_held_out().alias("held_out"), "lang_pred", "score"
    )
