"""Exact top-k by integer inner product: document-range blocks in the order of their bounds, until none can reach the k-th score.

A block's bound for a query is the sum, over terms, of the largest product that the block's maxima (or minima, where the query is
negative) allow. In a first pass over these maxima only, each query picks the best-bounded block of each range of blocks, and these are
scored through their forward indexes: the k-th best score so far is a threshold for the whole corpus. In a second pass
a query goes only to parts that hold a block whose bound reaches its threshold, and there from block to block while bounds do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm.common import checkpointed, groups_for, lean
from evoframe.llm.vectors import from_blob, matrix, to_blob, widened

SCALE = 1024
#: Below any score, and still a number whose negative is one.
NONE = -(1 << 63) + 1
#: Rows of a block, queries handled together; blocks of a part, and parts of a range.
BLOCK, QUERIES, PART_BLOCKS, RANGE_PARTS = 512, 256, 16, 64
BLOCK_SQL = "block long, ids array<long>, asks array<boolean>, width int, rows binary, high binary, low binary"
BLOCKS = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("asks", pa.list_(pa.bool_())), ("width", pa.int32()), ("rows", pa.binary()), ("high", pa.binary()), ("low", pa.binary())]
)


def blocks(vectors: DataFrame, is_query: str, size: int) -> DataFrame:
    """Row blocks of each task: the forward index (rows), and each term's largest and smallest value in the block.

    Rows are ordered by the term in which they are largest, so that a block's maxima are low elsewhere. asks: which rows are queries.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 24
        for batch in batches:
            x, ok = matrix(batch.column(1))
            ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                q = np.floor(SCALE * x)
            ok &= (np.abs(q) < 2.0**63).all(1)
            q, ids, asks = q[ok], batch.column(0).filter(pa.array(ok)).to_numpy(), batch.column(2).filter(pa.array(ok)).to_numpy(zero_copy_only=False)
            order = np.argsort(np.abs(q).argmax(1), kind="stable") if len(q) else []
            for a in range(0, len(q), size):
                at = order[a : a + size]
                own = q[at].astype(np.int64)
                row = {
                    "block": n, "ids": ids[at].tolist(), "asks": asks[at].tolist(), "width": own.shape[1], "rows": _packed(own),
                    "high": own.max(0).tobytes(), "low": own.min(0).tobytes(),
                }
                n += 1
                yield pa.RecordBatch.from_pylist([row], BLOCKS)

    asks = F.coalesce(F.expr(is_query), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").select("vec_id", "embedding", asks.alias("asks")).mapInArrow(run, BLOCK_SQL)


def _packed(x: np.ndarray) -> bytes:
    return to_blob(x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x)


def _rows(blob: bytes, n: int, own: int, width: int) -> np.ndarray:
    return widened(from_blob(blob, np.int32 if len(blob) - 8 == 4 * n * own else np.int64), width).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integers: doubles hold them below 2**53, else integer arithmetic (which wraps beyond 2**63)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


class Asked(NamedTuple):
    """Queries: a name of their row each, the row's place (block and number in it), its vec_id, and the score that a candidate has to reach."""

    block: np.ndarray
    number: np.ndarray
    ids: np.ndarray
    least: np.ndarray
    first: np.ndarray
    rows: np.ndarray

    def of(self, at: np.ndarray) -> Asked:
        return Asked(*(x[at] for x in self))


ASKED_FIELDS = [(c, pa.list_(pa.int64())) for c in ("q_block", "q_number", "q_ids", "q_least", "q_first")] + [("q_width", pa.int32()), ("q_rows", pa.binary())]
ASKED_SQL = "q_block array<long>, q_number array<long>, q_ids array<long>, q_least array<long>, q_first array<long>, q_width int, q_rows binary"


def _asked(t: pa.Table, r: int, width: int = 0) -> Asked:
    lists = [np.array(t[c][r].as_py(), np.int64) for c, _ in ASKED_FIELDS[:5]]
    own = t["q_width"][r].as_py()
    return Asked(*lists, _rows(t["q_rows"][r].as_py(), len(lists[0]), own, max(own, width)))


def _asked_row(q: Asked) -> dict:
    return {c: x.tolist() for (c, _), x in zip(ASKED_FIELDS, q, strict=False)} | {"q_width": q.rows.shape[1], "q_rows": _packed(q.rows)}


def queries(index: DataFrame) -> DataFrame:
    """The rows of the index that ask, some hundred to a row; chunk names the row."""
    schema = pa.schema([("chunk", pa.int64()), *ASKED_FIELDS])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = TaskContext.get().partitionId() << 32, []

        def out() -> pa.RecordBatch:
            width = max(q.rows.shape[1] for q in held)
            parts = [q._replace(rows=widened(q.rows, width)) for q in held]
            return pa.RecordBatch.from_pylist([{"chunk": n} | _asked_row(Asked(*(np.concatenate(x) for x in zip(*parts, strict=True))))], schema)

        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(row["asks"])
                if not len(at):
                    continue
                rows = _rows(row["rows"], len(row["ids"]), row["width"], row["width"])[at]
                same = lambda v, at=at: np.full(len(at), v, np.int64)
                held.append(Asked(same(row["block"]), at, np.array(row["ids"], np.int64)[at], same(NONE), same(-1), rows))
                if sum(len(q.ids) for q in held) >= QUERIES:
                    yield out()
                    n, held = n + 1, []
        if held:
            yield out()

    return index.select("block", "ids", "asks", "width", "rows").mapInArrow(run, f"chunk long, {ASKED_SQL}")


class Maxima:
    """The terms' largest and smallest values of some blocks, in the order of the blocks' numbers."""

    def __init__(self, t: pa.Table, width: int) -> None:
        order = np.argsort(t["block"].to_numpy())
        pad = lambda b: np.pad(np.frombuffer(b.as_py(), np.int64), (0, width - len(b.as_py()) // 8))
        self.block, self.part, self.order = t["block"].to_numpy()[order], t["part"].to_numpy()[order], order
        self.high, self.low = (np.stack([pad(t[c][int(r)]) for r in order]) for c in ("high", "low"))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return _products(np.maximum(q, 0), self.high) + _products(np.minimum(q, 0), self.low)


def search_part(q: Asked, part: pa.Table, maxima: Maxima, k: int, made: dict) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((query's block, number, id, row, score) of each query's k best rows of a part that reach its least score, and how many blocks were scored for how many queries)."""
    bound = maxima.bounds(q.rows)
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s, best_i = np.full((len(q.ids), k), NONE), np.full((len(q.ids), k), np.iinfo(np.int64).max)
    live, scored = np.arange(len(q.ids)), 0
    for step in range(len(maxima.block)):
        b = order[live, step]
        going = bound[live, b] >= np.maximum(best_s[live, -1], q.least[live])  # a tie can still win by its id
        live, b = live[going], b[going]
        if not len(live):
            break
        for place in np.unique(b).tolist():
            own = live[b == place]
            own = own[q.first[own] != maxima.block[place]]  # scored in the first pass
            if not len(own):
                continue
            r = int(maxima.order[place])
            if r not in made:
                ids = np.array(part["ids"][r].as_py(), np.int64)
                made[r] = ids, _rows(part["rows"][r].as_py(), len(ids), part["width"][r].as_py(), q.rows.shape[1])
            ids, rows = made[r]
            s = _products(q.rows[own], rows)
            mine = np.flatnonzero(q.block[own] == maxima.block[place])
            s[mine, q.number[own[mine]]] = NONE
            scored += len(own)
            all_s, all_i = np.concatenate([best_s[own], s], 1), np.concatenate([best_i[own], np.broadcast_to(ids, s.shape)], 1)
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[own], best_i[own] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    real = (best_s > NONE) & (best_s >= q.least[:, None])
    spread = lambda x: np.broadcast_to(x[:, None], real.shape)[real].tolist()
    return list(zip(spread(q.block), spread(q.number), spread(q.ids), best_i[real].tolist(), best_s[real].tolist(), strict=True)), scored


FOUND = ["q_block", "q_number", "query_id", "vec_id", "score"]
FOUND_SQL = ", ".join(f"{c} long" for c in FOUND)


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in FOUND]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=FOUND)


def _width(asked: pa.Table, index: pa.Table) -> int:
    return max([*asked["q_width"].to_pylist(), *index["width"].to_pylist()])


def _send(asked: DataFrame, maxima: DataFrame, key: str) -> DataFrame:
    """Queries meet the maxima of each range. key block: each goes to the range's best-bounded block; key part: to the parts where a bound reaches its least score."""
    schema = pa.schema([(key, pa.int64()), *ASKED_FIELDS])

    @lean
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            width = _width(left, right)
            m = Maxima(right, width)
            for r in range(left.num_rows):
                q = _asked(left, r, width)
                bound = m.bounds(q.rows)
                q = q._replace(first=m.block[bound.argmax(1)])
                if key == "block":
                    out += [{key: b} | _asked_row(q.of(q.first == b)) for b in np.unique(q.first).tolist()]
                    continue
                reach = (bound >= q.least[:, None]) & (m.block[None, :] != q.first[:, None])
                for p in np.unique(m.part).tolist():
                    at = reach[:, m.part == p].any(1)
                    if at.any():
                        out.append({key: p} | _asked_row(q.of(at)))
        return pa.Table.from_pylist(out, schema)

    return asked.groupBy("range", "asked").cogroup(maxima.groupBy("range", "asked")).applyInArrow(run, f"{key} long, {ASKED_SQL}")


def _score(sent: DataFrame, index: DataFrame, key: str, k: int) -> DataFrame:
    @lean
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            width, made = _width(left, right), {}
            m = Maxima(right, width)
            for r in range(left.num_rows):
                q = _asked(left, r, width)
                out += search_part(q._replace(first=np.full(len(q.ids), -1)) if key == "block" else q, right, m, k, made)[0]
        return _found(out)

    return sent.groupBy(key).cogroup(index.groupBy(key)).applyInArrow(run, FOUND_SQL)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_block", "q_number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, block: int = BLOCK, part_blocks: int = PART_BLOCKS, range_parts: int = RANGE_PARTS, chunks_together: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest inner product of floor(1024 * x), ties to the smaller vec_id.

    Candidates are all rows but the query's own. A vector that is null, empty, holds null or non-finite components or one that
    leaves 64-bit integers when scaled takes no part; of vectors of unlike length the shorter counts as padded with zeros; scores beyond 64 bits wrap; a
    repeated vec_id is several candidates and several queries; an empty table gives no rows; further columns are ignored.
    """
    index = checkpointed(blocks(vectors, is_query, block))
    asked = checkpointed(queries(index))
    # A range of maxima and a few rows of queries meet in a task, then a part of blocks and the queries sent to it.
    n_parts, n_asked = groups_for(index, part_blocks), groups_for(asked, chunks_together)
    n_ranges = -(-n_parts // range_parts)
    index = index.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_parts)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    maxima = index.select("block", "part", "width", "high", "low", F.pmod("part", F.lit(n_ranges)).alias("range")).withColumn("asked", each(n_asked))
    dealt = lambda df: df.withColumn("asked", F.pmod(F.xxhash64("chunk"), F.lit(n_asked))).withColumn("range", each(n_ranges))
    first = checkpointed(_score(_send(dealt(asked), maxima, "block"), index, "block", k))
    # The k-th best score so far, for each query that has as many.
    least = _best(first, k).where(F.col("rank") == k).select("q_block", "q_number", "score")
    of_chunk = asked.select("chunk", F.posexplode(F.arrays_zip("q_block", "q_number")).alias("place", "q")).select("chunk", "place", "q.q_block", "q.q_number")
    least = of_chunk.join(least, ["q_block", "q_number"], "left").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("score", F.lit(NONE)).alias("score")))).alias("least"))
    asked = asked.join(least, "chunk").withColumn("q_least", F.col("least.score")).drop("least")
    rest = _score(_send(dealt(asked), maxima, "part"), index, "part", k)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
