"""Removal of repeated passages: prefix doubling over the corpus's byte positions, as far as needed to compare strings of the threshold's length.

Ranks are 64-bit names, so equal strings of different tasks have equal ranks. Half the threshold is ranked where the text is read.
From there on, Spark deals (position, rank pair) entries out by rank and they are sorted at growing offsets, reranked by the pair, and
leave when they are unique or past the threshold:

1. offset 0: anchors, sorted by their rank. One whose rank stands in one document only is unique, and so is each string around it.
2. the offset between the two ends of the anchor's neighbourhood: neighbourhoods whose pair agrees are past the threshold as a whole.
3. the offset that makes up the threshold (the last step overlaps where the threshold is odd): every remaining position, by the pair
   of its own rank and that of the half after it.

A plain doubling sorts every byte position in each round, some 20 times the text in each shuffle. Anchors (the least-ranked half of each string,
about one position in thirteen, fixed by the string's bytes) are the reduction in front: every string of the threshold's length has one,
equal strings have equal ones, and only the pairs decide what is removed. Entries travel in blobs, many to a Spark row, with delta-coded ranks; steps
1 and 2 share one exchange, as the second key sorts within the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import U64, blob, checkpointed, dealt, lean, mix, spans, text_bytes, unblob
from evoframe.llm.suffixes import Anchors

THRESHOLD = 50
BLOCK, BLOCK_ANCHORS = 1 << 18, 1_000_000
#: Bytes of text for each group of ranks, and for each group of texts.
BYTES_PER_RANKS, BYTES_PER_TEXTS = 6 << 20, 4 << 20
#: Documents without an id are compared as the last of all, and dealt over so many addresses by their text.
NO_ID_ADDRESSES = 4096
NO_ID = (1 << 63) - 1 - NO_ID_ADDRESSES
#: A rank with more neighbourhoods than this in one task, or with more open ones than that in all, is frequent: the rest of a task's are dealt by
#: neighbourhood, for step 3 right away, and step 3 deals its positions by their pair instead of the anchor's rank.
FREQUENT, FREQUENT_OPEN = 8, 256
RANK_BITS, CONTEXT_BITS = U64(40), U64(48)
STEP_SQL = "target int, payload binary"


def _low(x: np.ndarray, bits: np.uint64) -> np.ndarray:
    return x & ((U64(1) << bits) - U64(1))


def _order(addresses: np.ndarray) -> np.ndarray:
    """What "smaller" compares: the document's id, and one value for all that have none."""
    return np.minimum(addresses, NO_ID)


def _deal(x: np.ndarray, groups: int) -> np.ndarray:
    return (mix(x.astype(U64)) % U64(groups)).astype(np.int64)


def _cut(x: np.ndarray) -> list[np.ndarray]:
    """48 bits as two columns."""
    return [(x >> U64(32)).astype("<u2"), (x & U64(0xFFFFFFFF)).astype("<u4")]


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(U64) << U64(32)) | low.astype(U64)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """The start of each run of equal keys in sorted columns, as marks."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _order_by(rank: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by all three: most ranks stand alone, so only the others are sorted by the rest."""
    order = np.argsort(rank)
    ranks = rank[order]
    same = np.zeros(len(ranks), bool)
    same[1:] = ranks[1:] == ranks[:-1]
    same[:-1] |= same[1:]
    some = order[same]
    order[same] = some[np.lexsort((doc[some], second[some], rank[some]))]
    return order


def _all(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"target": pa.array([t for t, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})


class Piece(NamedTuple):
    """A block of whole texts, or a part of a long one; parts overlap by one byte less than a string, so each string starts in one of them."""

    text: int
    start: int
    stop: int
    offsets: np.ndarray


def pieces(offsets: np.ndarray, most: int, overlap: int) -> Iterator[Piece]:
    for a, b in spans(offsets, most):
        start, stop = int(offsets[a]), int(offsets[b])
        if stop - start <= 2 * most:
            yield Piece(a, start, stop, offsets[a : b + 1] - start)
            continue
        for x in range(start, stop, most):
            y = min(stop, x + most + overlap)
            yield Piece(a, x, y, np.array([0, y - x]))


class _Sender:
    """Anchors of one task, sent on by rank. Of equal neighbourhoods only the smallest document's goes on; the others are decided already."""

    def __init__(self, ranks: int) -> None:
        self.ranks = ranks
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, rank: np.ndarray, context: np.ndarray, doc: np.ndarray) -> None:
        self.parts.append((rank, _low(context, CONTEXT_BITS), doc))
        self.n += len(rank)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        rank, context, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = _order_by(rank, context, doc)
        rank, context, doc = rank[order], context[order], doc[order]
        alike, each = _heads(rank, context), _heads(rank, context, doc)
        smallest = _order(doc[alike])[np.cumsum(alike) - 1]
        first = _order(doc) == smallest
        decided, sent = each & ~first, each & first
        # Frequent ranks: which of the entries to send come after the first few of their rank, and whether several documents hold it here.
        r, c, d = rank[sent], context[sent], doc[sent]
        new = _heads(r)
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        place = np.arange(len(r)) - starts[group]
        differ = np.minimum.reduceat(_order(d), starts) != np.maximum.reduceat(_order(d), starts)
        open_ = ((np.bincount(group) > FREQUENT) & differ)[group]
        target = (r >> RANK_BITS).astype(np.int64) % self.ranks
        target = np.where(open_ & (place >= FREQUENT), _deal(c, self.ranks), target)
        # What is decided only passes through on its way to its text, so any group will do: a frequent passage doesn't weigh on its own.
        done = dict(dealt(_deal(doc[decided], self.ranks), doc[decided], context[decided]))
        here = dict(dealt(target, r, c, d, open_))
        none = [np.zeros(0, np.int64), np.zeros(0, U64)]
        for t in sorted({*done, *here}):
            rank_, context_, doc_, flag = here.get(t, [none[1], none[1], none[0], np.zeros(0, bool)])
            by = np.argsort(rank_, kind="stable")
            ids, at = np.unique(doc_[by], return_inverse=True)
            done_doc, done_context = done.get(t, none)
            high = _steps(rank_[by] >> RANK_BITS)
            payload = blob(*high, np.diff(_low(rank_[by], RANK_BITS), prepend=U64(0)), *_cut(context_[by]), at.astype("<u4"), flag[by].astype("<u1"), ids.astype("<i8"), done_doc.astype("<i8"), *_cut(done_context))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([payload], pa.binary())], ["target", "payload"])


def _steps(x: np.ndarray) -> list[np.ndarray]:
    return [np.diff(x, prepend=U64(0)).astype("<u4")]


def send_anchors(docs: DataFrame, ranks: int, threshold: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(ranks)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in pieces(offsets, BLOCK, threshold - 1):
                found = Anchors(data[piece.start : piece.stop], piece.offsets, threshold)
                sender.add(found.rank, found.context, ids[piece.text + found.owner])
                if sender.n > BLOCK_ANCHORS:
                    yield from sender.rows()
        yield from sender.rows()

    return docs.select("address", "text").mapInArrow(run, STEP_SQL)


def resolve_anchors(sent: DataFrame, texts: int) -> DataFrame:
    """Steps 1 and 2: sort (rank, pair at the ends, document). To each document's group go the neighbourhoods decided as repeated, and those still open."""

    @lean
    def run(t: pa.Table) -> pa.Table:
        rank, context, doc, flag, done_doc, done = [], [], [], [], [], []
        for p in t["payload"]:
            top, step, high, low, at, f, ids, dd, dh, dl = unblob(p.as_py())
            rank.append((np.cumsum(top, dtype=U64) << RANK_BITS) | np.cumsum(step, dtype=U64))
            context.append(_joined(high, low))
            doc.append(ids[at])
            flag.append(f > 0)
            done_doc.append(dd)
            done.append(_joined(dh, dl))
        rank, context, doc, flag = (np.concatenate(x) for x in (rank, context, doc, flag))
        order = _order_by(rank, context, doc)
        rank, context, doc, flag = rank[order], context[order], doc[order], flag[order]
        new, alike = _heads(rank), _heads(rank, context)
        group, starts, own = np.cumsum(new) - 1, np.flatnonzero(new), _order(doc)
        smallest = own[alike][np.cumsum(alike) - 1]
        several = often = flag
        if len(rank):
            differ, marked = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts), np.bincount(group, flag) > 0
            several = ((np.bincount(group, alike) > 1) & differ | marked)[group]
            often = (marked | (np.bincount(group, own == smallest) > FREQUENT_OPEN))[group]
        decided, open_ = own > smallest, (own == smallest) & several
        rare, often = open_ & ~often, open_ & often
        to, what = np.concatenate([doc[decided], *done_doc]), np.concatenate([context[decided], *done])
        lists = [dict(dealt(_deal(d, texts), d, c)) for d, c in ((to, what), (doc[rare], context[rare]), (doc[often], context[often]))]
        none = [np.zeros(0, np.int64), np.zeros(0, U64)]
        return _table([(k, blob(*(column for x in lists for column in _listed(*x.get(k, none))))) for k in sorted({*lists[0], *lists[1], *lists[2]})])

    return sent.groupBy("target").applyInArrow(run, STEP_SQL)


def _listed(doc: np.ndarray, name: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((name, doc))
    new = _heads(doc[order], name[order])
    return [np.diff(doc[order][new], prepend=0).astype("<i8"), *_cut(name[order][new])]


def _read_list(parts: list[list[np.ndarray]]) -> np.ndarray:
    """One sorted number for each listed (document, name)."""
    return np.sort(np.concatenate([np.zeros(0, U64), *(_entry(np.cumsum(d), _joined(h, low)) for d, h, low in parts)]))


def _entry(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(U64)) + name)


def _is_in(entries: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(entries), bool)
    return listed[np.minimum(np.searchsorted(listed, entries), len(listed) - 1)] == entries


class _Texts:
    """A group of texts."""

    def __init__(self, t: pa.Table, threshold: int) -> None:
        t = t.take(pa.compute.sort_indices(t["address"]))
        self.ids, self.carried = t["address"].to_numpy(), t.drop_columns(["target", "address", "text"])
        unpress = zstandard.ZstdDecompressor().decompress
        self.data, self.offsets = text_bytes(pa.array([unpress(x.as_py()) for x in t["text"]], pa.large_binary()))
        self.threshold = threshold

    def judged(self, lists: list[list[np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str, np.ndarray]]:
        """Intervals of bytes in neighbourhoods decided as repeated, and every window of the open ones: its anchor's rank, whether that is frequent, its name (the pair), its document, its place."""
        full, rare, often = (_read_list([x[i : i + 3] for x in lists]) for i in (0, 3, 6))
        intervals, out = [], {"rank": [], "often": [], "name": [], "doc": [], "at": []}
        for piece in pieces(self.offsets, BLOCK, self.threshold - 1):
            found = Anchors(self.data[piece.start : piece.stop], piece.offsets, self.threshold)
            if not len(found.first):
                continue
            doc = self.ids[piece.text + found.owner]
            entries = _entry(doc, _low(found.context, CONTEXT_BITS))
            hit = _is_in(entries, full)
            intervals.append((piece.start + found.first[hit], piece.start + found.last[hit] + self.threshold))
            frequent = _is_in(entries, often)
            runs = np.flatnonzero((frequent | _is_in(entries, rare)) & ~hit)
            run, at = found.windows(runs)
            out["rank"].append(found.rank[runs][run])
            out["often"].append(frequent[runs][run])
            out["name"].append(_low(found.pairs(at, at + found.apart), CONTEXT_BITS))
            out["doc"].append(doc[runs][run])
            out["at"].append(piece.start + at)
        return intervals, {k: _all(v, {"rank": U64, "name": U64, "often": bool}.get(k, np.int64)) for k, v in out.items()}


def _sorted_windows(windows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows by (rank, name, document); again: the same string starts in a smaller document of the group."""
    order = _order_by(windows["rank"], windows["name"], windows["doc"])
    out = {k: x[order] for k, x in windows.items()}
    alike, own = _heads(out["rank"], out["name"]), _order(out["doc"])
    return out | {"again": own > own[alike][np.cumsum(alike) - 1]}


def send_windows(texts: DataFrame, decided: DataFrame, ranks: int, threshold: int) -> DataFrame:
    """Step 3's entries: the pair at each open position, once for the smallest document of a group that has it."""

    @lean
    def run(t: pa.Table, steps: pa.Table) -> pa.Table:
        if not steps.num_rows or not t.num_rows:
            return _table([])
        lists = [unblob(p.as_py()) for p in steps["payload"]]
        w = _sorted_windows(_Texts(t, threshold).judged(lists)[1])
        sent = _heads(w["rank"], w["name"], w["doc"]) & ~w["again"]
        rank, name, doc, often = (w[k][sent] for k in ("rank", "name", "doc", "often"))
        rows = []
        for k, (r, n, d) in dealt(_deal(np.where(often, rank ^ name, rank), ranks), rank, name, doc):
            # By document, then rank: the positions around an anchor stand together.
            by = np.lexsort((n, r, d))
            rows.append((k, blob(_low(r[by], RANK_BITS) - np.append(U64(0), _low(r[by][:-1], RANK_BITS)), *_cut(n[by]), np.diff(d[by], prepend=0).astype("<i8"))))
        return _table(rows)

    return texts.groupBy("target").cogroup(decided.groupBy("target")).applyInArrow(run, STEP_SQL)


def resolve_windows(sent: DataFrame, texts: int) -> DataFrame:
    """Step 3: sort (rank, pair, document); a string that also starts in a smaller document goes back to its text by name."""

    @lean
    def run(t: pa.Table) -> pa.Table:
        rank, name, doc = [], [], []
        for p in t["payload"]:
            r, high, low, d = unblob(p.as_py())
            rank.append(np.cumsum(r, dtype=U64))
            name.append(_joined(high, low))
            doc.append(np.cumsum(d))
        rank, name, doc = (np.concatenate(x) for x in (rank, name, doc))
        order = _order_by(rank, name, doc)
        rank, name, doc = rank[order], name[order], doc[order]
        alike = _heads(rank, name)
        hit = _order(doc) > _order(doc[alike])[np.cumsum(alike) - 1]
        return _table([(k, blob(*_listed(d, n))) for k, (d, n) in dealt(_deal(doc[hit], texts), doc[hit], name[hit])])

    return sent.groupBy("target").applyInArrow(run, STEP_SQL)


DIGEST_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, threshold: int = THRESHOLD, digests: bool = False, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Every document without the bytes covered by a string of `threshold` bytes that also starts in a document of smaller id.

    Returns (doc_id, kept bytes, the columns to carry), with as_text whole characters as a string, or with digests counts and a hash
    of the kept bytes. Strings are judged on the input. A text of null or shorter than the threshold stays as it is; a null doc_id
    counts as the largest (so do the 4096 largest numbers there are); rows of equal id, or of none, never remove bytes from each other, and each loses only strings that its
    own text has; an empty table gives no rows; further columns are ignored.
    """
    if threshold < 2:
        raise ValueError("a string of the threshold's length has two halves")
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID_ADDRESSES))).alias("address"),
        F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carry,
    )
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranks, texts = 1 + size // BYTES_PER_RANKS, 1 + size // BYTES_PER_TEXTS
    by_text = _texts_by_group(own, texts)
    decided = checkpointed(resolve_anchors(send_anchors(own, ranks, threshold), texts), 2 * ranks)
    windows = resolve_windows(send_windows(by_text, decided, ranks, threshold), texts)
    return _finish(by_text, decided.unionByName(windows), threshold, digests, as_text)


def _texts_by_group(own: DataFrame, texts: int) -> DataFrame:
    names = ["target", "address", "text", *own.columns[2:]]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            target = _deal(batch.column(0).to_numpy(), texts)
            packed = pa.array([press.compress(x.as_py() or b"") for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), batch.column(0), packed, *batch.columns[2:]], names)

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:])
    return own.mapInArrow(run, f"target int, address long, text binary{kinds}")


def _finish(by_text: DataFrame, steps: DataFrame, threshold: int, digests: bool, as_text: bool) -> DataFrame:
    @lean
    def run(t: pa.Table, steps: pa.Table) -> pa.Table:
        lists = [unblob(p.as_py()) for p in steps["payload"]]
        own = _Texts(t, threshold)
        intervals, windows = own.judged([x for x in lists if len(x) == 9])
        w = _sorted_windows(windows)
        at = w["at"][w["again"] | _is_in(_entry(w["doc"], w["name"]), _read_list([x for x in lists if len(x) == 3]))]
        intervals.append((at, at + threshold))
        lost, until = (np.sort(_all(x, np.int64)) for x in zip(*intervals, strict=True))
        out = []
        for a, b in spans(own.offsets, BLOCK):
            start, stop = int(own.offsets[a]), int(own.offsets[b])
            gone, offsets = _covered(lost, until, start, stop), (own.offsets[a : b + 1] - start).tolist()
            for k in range(b - a):
                i, j = offsets[k], offsets[k + 1]
                some = gone[i:j]
                if some.any():
                    raw, n = own.data[start + i : start + j][~some].tobytes(), int(np.count_nonzero(some))
                    runs = int(some[0]) + int(np.count_nonzero(some[1:] & ~some[:-1]))
                else:
                    raw, n, runs = own.data[start + i : start + j].tobytes(), 0, 0
                out.append((j - i, n, runs, hashlib.sha256(raw).hexdigest()) if digests else (raw.decode("utf-8", "ignore") if as_text else raw,))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digests else [pa.string() if as_text else pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digests else ["kept"]
        columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
        made = pa.table([own.carried["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])
        for name in own.carried.column_names[1:] if not digests else ():
            made = made.append_column(name, own.carried[name])
        return made

    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in by_text.schema.fields[4:])
    return by_text.groupBy("target").cogroup(steps.groupBy("target")).applyInArrow(run, DIGEST_SQL if digests else f"doc_id long, kept {'string' if as_text else 'binary'}{carried}")


def _covered(lost: np.ndarray, until: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Which bytes from start to stop lie in an interval: as many have begun as ended, or not. Both ends are sorted; none lies across texts."""
    n = stop - start
    begun = lost[np.searchsorted(lost, start) : np.searchsorted(lost, stop)] - start
    ended = until[np.searchsorted(until, start, side="right") : np.searchsorted(until, stop, side="right")] - start
    edge = np.bincount(begun, minlength=n + 1)
    edge -= np.bincount(ended, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def drop_passages(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, all their columns, with a text of the kept bytes (a character that lost some of its bytes goes); null texts stay null."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col("text").isNull().alias("was_null"))
    out = dedup(named, threshold, carry=(*[f"c{i}" for i in range(len(rest))], "was_null"), as_text=True)
    text = F.when(~F.col("was_null"), F.col("kept"))
    return out.select("doc_id", text.alias("text"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)]).select(*docs.columns)
