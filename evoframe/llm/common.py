"""Shared pieces: checkpoints, Arrow text buffers, hashing, connected components."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.session import ship

U64 = np.uint64
#: Odd multipliers; any odd numbers would do.
GOLDEN, M1, M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; a temporary one only where that is unset.

    files: at most so many (12 at least), for tables that are small against the number of shuffle partitions; it is to grow with the data.
    """
    if files is not None:
        df = df.coalesce(max(12, files))
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="evoframe-ckpt-"))
    return df.checkpoint(eager=True)


@cache
def _allocator() -> ctypes.CDLL | None:
    """The C library, from which Arrow takes its memory too; None where it isn't glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim
    except (OSError, AttributeError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


#: What modules keep in a worker from task to task, and how it is dropped: it goes when another module's function comes in.
KEPT: dict[str, Callable[[], None]] = {}


def _drop_others(module: str) -> None:
    for owner, drop in KEPT.items():
        if owner != module:
            drop()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = _allocator()
    if libc:
        libc.malloc_trim(0)


def lean(f: Callable) -> Callable:
    """An Arrow function of a Python worker that gives its memory back when it is done; workers are kept from task to task, and share the executor's memory."""
    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(batches):
            _allocator()
            _drop_others(f.__module__)
            try:
                yield from f(batches)
            finally:
                _trim()

        return run
    if len(inspect.signature(f).parameters) == 2:

        @wraps(f)
        def two(left, right):
            _allocator()
            _drop_others(f.__module__)
            try:
                return f(left, right)
            finally:
                _trim()

        return two

    @wraps(f)
    def one(t):
        _allocator()
        _drop_others(f.__module__)
        try:
            return f(t)
        finally:
            _trim()

    return one


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that the frame's columns don't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def groups_for(df: DataFrame, rows_per_group: int) -> int:
    """How many groups of about that many rows the frame makes; grows with the data."""
    return max(1, -(-df.count() // rows_per_group))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix): a bijection, so it adds no collisions."""
    x = x ^ (x >> U64(30))
    x = x * M1
    x ^= x >> U64(27)
    x = x * M2
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and their offsets (n + 1); a null counts as empty."""
    a = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    n = len(a)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    data = a.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts of about `most` bytes each (a longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


#: Edges in one file of a step of components(): few edges don't need as many files as there are shuffle partitions.
EDGES_PER_FILE = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(id, component_id) of every vertex of an edge: the smallest id that edges lead to.

    Alternating large-star and small-star steps; a hub's rows meet its minimum in a join that
    adaptive execution can split, after partial aggregation. Rows with a null end or a loop are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e, before = checkpointed(e, files), None
    files = max(1, e.count() // EDGES_PER_FILE)  # the number of edges doesn't grow from here
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select("a", F.col("m").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = checkpointed(small.where("a <> b").distinct().coalesce(files))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)


class Forest:
    """Union-find over small integers, smallest root wins: a task keeps a spanning forest instead of all its links."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


_KINDS = [np.dtype(k) for k in ("u1", "<u4", "<u8", "<i4", "<i8", "<f8", "<u2")]


def blob(*arrays: np.ndarray) -> bytes:
    """Number columns in one compressed string, byte plane by byte plane: a shuffle's rows of one task for one target."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        parts.append(bytes([_KINDS.index(a.dtype)]) + len(a).to_bytes(8, "little"))
    for a in arrays:
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unblob(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at, out = 1 + 9 * raw[0], []
    for i in range(raw[0]):
        kind, n = _KINDS[raw[1 + 9 * i]], int.from_bytes(raw[2 + 9 * i : 10 + 9 * i], "little")
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n) if n else np.zeros((kind.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def dealt(target: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each target, in their order."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    target = target[order]
    edges = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(target)], strict=True):
        yield int(target[a]), [x[order[a:b]] for x in arrays]
