"""Embedding near-duplicates by collision counting: windows on many sorted projections, then verification.

For a pair at a given cosine, the difference of its projections on random directions has one distribution,
whatever the data. So the windows, the number of collisions asked for and the number of cells per vector are
calibrated on random pairs at exactly the threshold, the hardest ones to find.

Windows that hold such a pair also hold some 40 % of all vectors, so on whole projections they would give all pairs of a label. They are therefore
counted inside cells: the ends of further sorted projections, each vector being in those at which it is furthest out. A
link is counted in the first cell that both its vectors share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import Forest, checkpointed, components, lean
from evoframe.llm.vectors import matrix

COSINE = 0.93
#: Projections on which collisions are counted; window half-width in standard deviations of a pair at the threshold.
PROJECTIONS, WIDTH = 24, 1.5
#: Share of pairs at the threshold that each of the two steps may lose.
LOSS = 0.005
#: Vectors of the most frequent label for each direction that deals them to cells; rows of one block of a large cell.
PER_CELL, BLOCK = 800, 4096
#: Directions of one level; where more are needed, a cell is one of the first level's and one of the next one's.
MOST_DIRECTIONS = 8192
#: Numbers of a matrix of vectors and directions, or of pairs, that are held at once.
AT_ONCE = 1 << 21


@cache
def directions(n: int, width: int, seed: int) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((n, width))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tails(unit: np.ndarray, n: int, r: int, level: int = 0) -> np.ndarray:
    """The r ends of sorted projections at which each vector is furthest out (c + n is the lower end of c)."""
    p = unit @ directions(n, unit.shape[1], 11 + 100 * level).T
    both = np.concatenate([p, -p], 1)
    r = min(r, both.shape[1])
    return np.argpartition(-both, r - 1, axis=1)[:, :r]


def own_cells(unit: np.ndarray, n: tuple[int, ...], cosine: float) -> np.ndarray:
    """The cells of each vector, ascending: a tail of each level."""
    out = np.zeros((len(unit), 1), np.int64)
    for level, k in enumerate(n):
        own = tails(unit, k, calibrated(k, unit.shape[1], cosine, len(n))[0], level)
        out = (out[:, :, None] * (2 * k) + own[:, None, :]).reshape(len(unit), -1)
    return np.sort(out, axis=1)


def levels(vectors: int) -> tuple[int, ...]:
    """Numbers of directions, level by level, for so many vectors of one label."""
    need, deep = max(1, vectors // PER_CELL), 1
    while MOST_DIRECTIONS**deep < need:
        deep += 1
    n = 8
    while n**deep < need:
        n *= 2
    return (n,) * deep


class Projections:
    """Vectors on the counted projections, each of them sorted."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, order = values, np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, 0)
        self.rank = np.empty(values.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(values), dtype=np.int32)[:, None], 0)

    def collisions(self, queries: np.ndarray, half: float) -> np.ndarray:
        """For each query and vector, on how many projections the vector lies in the window around the query: between two places of the sorted projection."""
        counts = np.zeros((len(queries), len(self.values)), np.uint8)
        for k in range(self.values.shape[1]):
            low = np.searchsorted(self.sorted[:, k], queries[:, k] - half, "left")
            high = np.searchsorted(self.sorted[:, k], queries[:, k] + half, "right")
            rank = self.rank[:, k]
            counts += (rank >= low[:, None]) & (rank < high[:, None])
        return counts


@cache
def calibrated(n: int, width: int, cosine: float = COSINE, deep: int = 1, pairs: int = 4000) -> tuple[int, int, float]:
    """(tails for each vector on each of so many levels, least collisions, window) that lose at most LOSS each of random pairs at the threshold."""
    rng = np.random.default_rng(17)
    x = rng.standard_normal((pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, width))
    y -= (x * y).sum(1, keepdims=True) * x
    y *= np.sqrt(max(0.0, 1 - cosine**2)) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y += cosine * x
    p, q = x @ directions(n, width, 11).T, y @ directions(n, width, 11).T
    p, q = np.argsort(-np.concatenate([p, -p], 1), axis=1), np.argsort(-np.concatenate([q, -q], 1), axis=1)
    r = 1
    while r < p.shape[1] and (p[:, :r, None] == q[:, None, :r]).any((1, 2)).mean() < 1 - LOSS / deep:
        r += 1
    half = WIDTH * np.sqrt(2 * (1 - cosine) / width)
    g = directions(PROJECTIONS, width, 13)
    hits = np.sort((np.abs(x @ g.T - y @ g.T) <= half).sum(1))
    return r, max(1, int(hits[int(LOSS * pairs)])), float(half)


def cells(classes: DataFrame, n: tuple[int, ...], cosine: float) -> DataFrame:
    """Each class under each of its cells, with the vector as the table has it."""
    kind = {f.name: f.dataType for f in classes.schema.fields}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            x, _ = matrix(vectors)
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():  # vectors of unlike length never link
                at = np.flatnonzero(sizes == width)
                step = max(16, AT_ONCE // (2 * max(n)))
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    own = own_cells(scaled(x[some, :width]), n, cosine)
                    r = own.shape[1]
                    rows = pa.array(np.repeat(some, r))
                    lists = pa.ListArray.from_arrays(np.arange(0, own.size * r + 1, r, dtype=np.int32), pa.array(np.repeat(own, r, axis=0).ravel()))
                    columns = [batch.column("label").take(rows), pa.array(own.ravel()), lists, batch.column("cid").take(rows), batch.column("m").take(rows), pa.array(np.full(len(rows), width, np.int32)), vectors.take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, ["label", "cell", "cells", "cid", "m", "width", "embedding"])

    schema = f"label {kind['label'].simpleString()}, cell long, cells array<long>, cid long, m long, width int, embedding {kind['embedding'].simpleString()}"
    return classes.mapInArrow(run, schema)


FOUND_SQL = "cid long, links long, other long"


def _links(cell: int, left: pd.DataFrame, right: pd.DataFrame | None, cosine: float) -> Iterator[tuple[int, int, int]]:
    """What a cell (or two blocks of it) shows: (cid, links, 0) and, with 0 links, edges (cid, 0, other) of a spanning forest.

    A link is counted only in the first cell that both vectors share.
    """
    sides = [left] if right is None else [left, right]
    ids = [s["cid"].to_numpy() for s in sides]
    x = [scaled(np.stack(s["embedding"]).astype(np.float64)) for s in sides]
    width = x[0].shape[1]
    _, least, half = calibrated(16, width, cosine)
    g = directions(PROJECTIONS, width, 13)
    p, right_side = [v @ g.T for v in x], Projections(x[-1] @ g.T)
    own = [np.stack(s["cells"]) for s in sides]
    shift = 0 if right is None else len(ids[0])
    every, m = np.concatenate(ids), np.concatenate([s["m"].to_numpy() for s in sides])
    total, forest = np.zeros(len(every)), Forest(len(every))
    step = max(1, AT_ONCE // len(x[-1]))
    for top in range(0, len(x[0]), step):
        a, b = np.nonzero(right_side.collisions(p[0][top : top + step], half) >= least)
        a += top
        if right is None:
            a, b = a[a < b], b[a < b]
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 50_000):
            u, v = a[i : i + 50_000], b[i : i + 50_000]
            shared = (own[0][u][:, :, None] == own[-1][v][:, None, :]).any(2)
            first = own[0][u][np.arange(len(u)), shared.argmax(1)] == cell
            keep[i : i + 50_000] = first & (np.einsum("ij,ij->i", x[0][u], x[-1][v]) >= cosine)
        a, b = a[keep], b[keep] + shift
        total += np.bincount(a, m[b], len(every)) + np.bincount(b, m[a], len(every))
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if forest.join(i, j):
                yield int(every[i]), 0, int(every[j])
    for i in np.flatnonzero(total).tolist():
        yield int(every[i]), int(total[i]), 0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors of one label are one class, linked to each other by definition and searched once. A vector that is null,
    empty, zero, or holds null or non-finite components, or whose label is null, links with nothing, nor do vectors of unlike
    length. A label may be of any type that can be grouped by. A repeated vec_id stays several rows, counted one by one; an empty table gives no rows; further columns are ignored.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole, F.lit(False))
    # Equal vectors meet by two 64-bit names; a class is then numbered, so that no two share a number.
    names = [F.when(valid, F.xxhash64("label", "embedding")).alias("h"), F.when(valid, F.xxhash64("embedding", F.lit(1), "label")).alias("h2")]
    rows = vectors.select(F.col("vec_id").cast("long"), *names, "label", "embedding")
    classes = rows.where("h is not null").groupBy("h", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("m"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = levels(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    dealt = cells(classes, n, cosine)
    # A large cell is split into blocks, and each pair of blocks is a group: no task holds more than two blocks.
    sizes = dealt.groupBy("label", "cell", "width").agg(F.count("*").alias("size")).where("size > 1")
    large = checkpointed(sizes.select("label", "cell", "width", F.ceil(F.col("size") / BLOCK).alias("blocks")))
    dealt = dealt.join(large, ["label", "cell", "width"]).withColumn("s", F.pmod(F.xxhash64("cid"), "blocks"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"s1": F.least("s", "t"), "s2": F.greatest("s", "t")}).drop("blocks", "t")

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        _, cell, _, s1, s2 = key
        pdf = pdf.sort_values("cid", ignore_index=True)
        if s1 == s2:
            found = _links(int(cell), pdf, None, cosine)
        else:
            left, right = pdf[pdf["s"] == s1], pdf[pdf["s"] == s2]
            found = _links(int(cell), left, right, cosine) if len(left) and len(right) else ()
        out = np.array(list(found), np.int64).reshape(-1, 3)
        return pd.DataFrame(out, columns=["cid", "links", "other"])

    found = checkpointed(dealt.groupBy("label", "cell", "width", "s1", "s2").applyInPandas(one, FOUND_SQL))
    links = found.where("links > 0").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.where("links = 0").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    out = (
        rows.select("vec_id", "h", "h2").join(classes.select("h", "h2", "cid", "m"), ["h", "h2"], "left").join(links, "cid", "left")
        .join(parts.withColumnRenamed("id", "cid"), "cid", "left")
        .withColumn("part", F.coalesce("component_id", "cid"))
    )
    smallest = checkpointed(out.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("smallest")))
    return out.join(smallest, "part", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("smallest", "vec_id").alias("component_id"),
        (F.coalesce("smallest", "vec_id") == F.col("vec_id")).alias("kept"),
    )
