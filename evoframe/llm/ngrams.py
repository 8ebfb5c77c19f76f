"""N-gram Jaccard join as a T-occurrence problem, solved by DivideSkip.

Two sets of sizes m <= n with a Jaccard similarity of at least s share at least T = s / (1 + s) * (m + n) shingles, so of a
query's inverted lists its T - 1 longest ones can be left out of the merge: what it is to find is on one of the others.

Across the corpus, the short lists (of each document's rarest shingles, by one order for the whole corpus) decide which documents
meet in a group. Each group then has its own inverted index over the whole sets of its documents, in which every query is answered by DivideSkip: its
short lists are heap-merged, which yields candidates with partial counts, its long ones are probed by binary search for those
candidates only, and those that reach the required overlap are linked.

Links only serve to connect, so a long short-list (a large group of near copies) isn't expanded into all its pairs: a first
round brings its documents together with two leaders and with their neighbours in size, a second one every pair that the first left in different components.
Long lists are dealt in chunks in both rounds.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import GOLDEN, U64, Forest, blob, checkpointed, components, dealt, fresh, lean, mix, spans, text_bytes, unblob
from evoframe.llm.shingles import WORDS, shingle_sets

#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Counters of shingle frequencies: 2**SKETCH_BITS numbers of 4 bytes, whatever the corpus; they only order the lists.
SKETCH_BITS, SLICES = 22, 16
#: So many tasks' counts are summed up in one step; their sums again, until one is left.
FAN = 32
BLOCK, BLOCK_POSTINGS = 1 << 19, 500_000
#: Documents of a file between steps, of a bucket of lists; pairs of a group, and bytes of packed texts in it; partners of a query that stay together.
DOCS_PER_FILE, DOCS_PER_BUCKET, PAIRS_PER_GROUP, BYTES_PER_GROUP, PER_LEADER = 1000, 4000, 2000, 3 << 20, 200
#: Lists of up to so many documents are compared in full at once; longer ones in chunks of about so many; in the second round, so many at most of those outside the largest component meet a chunk at once.
SMALL, CHUNK, ACROSS = 12, 250, 2000
TOKEN_BITS = U64(48)


def least_shared(a: int, b: int) -> int:
    """T: how many shingles sets of these sizes share at least if they are linked."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of a set's rarest shingles find its larger partners' lists, and how many lists it is found on by smaller ones."""
    found = n - -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR)) + 1
    probe = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    return np.where(n > 0, found, 0), np.where(n > 0, probe, 0)


def set_names(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One name for each set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(sizes)
        sums = np.append(U64(0), np.cumsum(mix(values ^ GOLDEN), dtype=U64))
        return mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64) * GOLDEN)


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SKETCH_BITS)).astype(np.int64)


FIRST_SQL = "slice int, payload binary"
SUM_SQL = "slice int, chunk int, payload binary"


def _row(key: int, payload: bytes, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([payload], pa.binary())], [name, "payload"])


def first_pass(docs: DataFrame) -> DataFrame:
    """Documents with the size and name of their sets (slice -1), and each task's counts of shingles by hashed slots."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, rows, again = (batch.column(k).to_numpy() for k in (0, 2, 3))
            for a, b in spans(offsets, BLOCK):
                values, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                np.add.at(counts, _slot(values), 1)
                yield _row(-1, blob(ids[a:b].astype("<i8"), rows[a:b].astype("<i8"), again[a:b].astype("<i8"), sizes.astype("<u4"), set_names(values, sizes)), "slice")
        for k, part in enumerate(np.split(counts, SLICES)):
            yield _row(k, blob(part), "slice")

    return docs.mapInArrow(run, FIRST_SQL)


def sketch(first: DataFrame) -> np.ndarray:
    """The tasks' counts summed up by slices, as a tree of partial sums; of one size whatever the corpus."""

    @lean
    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint32)
        for p in t["payload"]:
            part = unblob(p.as_py())[0].astype(np.uint32)
            total = np.maximum(part, part + total) if len(total) else part  # a count that runs over stays large
        return pa.table({"slice": t["slice"].slice(0, 1), "chunk": t["chunk"].slice(0, 1), "payload": pa.array([blob(total)], pa.binary())})

    tasks = first.rdd.getNumPartitions()
    parts = first.where("slice >= 0").select("slice", F.spark_partition_id().alias("chunk"), "payload")
    while tasks:
        tasks = (tasks - 1) // FAN
        parts = parts.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("int")).groupBy("slice", "chunk").applyInArrow(run, SUM_SQL)
    rows = parts.collect()
    return np.concatenate([unblob(r.payload)[0] for r in sorted(rows, key=lambda r: r.slice)]) if rows else np.zeros(1 << SKETCH_BITS, np.uint32)


def set_rows(first: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0):
                ids, rows, again, sizes, names = unblob(p.as_py())
                columns = [pa.array(ids), pa.array(rows), pa.array(again), pa.array(sizes.astype(np.int64)), pa.array(names.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_key", "row", "row2", "n_shingles", "cls"])

    return first.where("slice < 0").select("payload").mapInArrow(run, "doc_key long, row long, row2 long, n_shingles long, cls long")


def postings(docs: DataFrame, often, buckets: int) -> DataFrame:
    """Short-list entries of distinct sets, dealt by shingle: (shingle, set, its size, the shingle's place in the set's order)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n_held, seen = often.value, [], 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            token, cls, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
            for k, (t, c, s, f) in dealt((token >> TOKEN_BITS).astype(np.int64) % buckets, token & ((U64(1) << TOKEN_BITS) - U64(1)), cls, size, place):
                by = np.argsort(t, kind="stable")
                names, at, back = np.unique(c[by], return_index=True, return_inverse=True)
                yield _row(k, blob(np.diff(t[by], prepend=U64(0)), back.astype("<u4"), np.minimum(f[by], 65535).astype("<u2"), names, s[by][at].astype("<u4")), "bucket")

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in spans(offsets, BLOCK):
                values, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names = set_names(values, sizes)
                fresh = np.array([not (x in seen or seen.add(x)) for x in names.tolist()], bool) & (sizes > 0)
                owner = np.repeat(np.arange(b - a), sizes)
                order = np.lexsort((values, counts[_slot(values)], owner))
                rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                _, probe = prefix_sizes(sizes)
                keep = (rank < probe[owner]) & fresh[owner]
                own = owner[keep]
                held.append((values[order][keep], names[own], sizes[own], rank[keep]))
                n_held += int(keep.sum())
                if n_held > BLOCK_POSTINGS:
                    yield from out()
                    held, n_held, seen = [], 0, set()
        if held:
            yield from out()

    return docs.mapInArrow(run, "bucket int, payload binary")


def short_lists(sent: DataFrame) -> DataFrame:
    """The distinct member lists of shingles that several sets hold: (list, cls, n, place, size) by rows.

    place is the first one that the set has for any of the shingles with this list.
    """

    @lean
    def run(t: pa.Table) -> pa.Table:
        bucket, parts = t["bucket"][0].as_py(), []
        for p in t["payload"]:
            step, at, place, names, sizes = unblob(p.as_py())
            parts.append((np.cumsum(step, dtype=U64), names[at], sizes[at].astype(np.int64), place.astype(np.int64)))
        token, cls, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((cls, token))
        token, cls, size, place = token[order], cls[order], size[order], place[order]
        new = _heads(token, cls)  # else a set that several tasks sent
        token, cls, size, place = token[new], cls[new], size[new], place[new]
        head = _heads(token)
        group = np.cumsum(head) - 1
        count = np.bincount(group)
        found = place < prefix_sizes(size)[0]
        use = ((count > 1) & (np.bincount(group, found) > 0))[group]
        label = np.add.reduceat(mix(cls), np.flatnonzero(head))[group] if len(cls) else cls  # equal lists have equal sums of names
        label, cls, size, place, count = label[use], cls[use], size[use], place[use], count[group[use]]
        order = np.lexsort((place, cls, label))
        label, cls, size, place, count = label[order], cls[order], size[order], place[order], count[order]
        first = _heads(label, cls)
        lists = np.cumsum(_heads(label)) - 1 if len(label) else np.zeros(0, np.int64)
        return pa.table({
            "list": pa.array((lists[first].astype(np.int64) << 20) + bucket), "cls": pa.array(cls[first].view(np.int64)), "n": pa.array(size[first]),
            "place": pa.array(place[first]), "size": pa.array(count[first]),
        })

    return sent.groupBy("bucket").applyInArrow(run, "list long, cls long, n long, place long, size long")


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    for i, k in enumerate(keys):
        new[1:] = k[1:] != k[:-1] if not i else new[1:] | (k[1:] != k[:-1])
    return new


def _may_link(n_a: np.ndarray, n_b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle has these places can share enough: what is left from there on bounds it. A pair shows on its first one too."""
    need = -(-NUMERATOR * (n_a + n_b) // (NUMERATOR + DENOMINATOR))
    return (np.minimum(n_a - place_a, n_b - place_b) >= need) & (DENOMINATOR * np.minimum(n_a, n_b) >= NUMERATOR * np.maximum(n_a, n_b))


AT_ONCE = 1 << 20
PAIRS_SQL = "a long, b long"


class _Members:
    """Rows of a group in the order of (list, chunk, size), and the pairs of them that may be linked."""

    def __init__(self, t: pa.Table) -> None:
        keys = [t[c].to_numpy() for c in ("cls", "n", "chunk", "list")]
        order = np.lexsort(keys)
        self.cls, self.n, chunk, lists = (x[order] for x in keys)
        self.place, self.t, self.order = t["place"].to_numpy()[order], t, order
        heads = np.flatnonzero(_heads(lists, chunk)).tolist() if len(order) else []
        self.runs = list(zip(heads, [*heads[1:], len(order)], strict=True))
        self.found = [np.zeros((0, 2), np.int64)]

    def column(self, name: str) -> np.ndarray:
        return self.t[name].to_numpy()[self.order]

    def add(self, cls: np.ndarray, n: np.ndarray, place: np.ndarray, j: np.ndarray, also: np.ndarray | bool = True) -> None:
        ok = (cls != self.cls[j]) & _may_link(n, self.n[j], place, self.place[j]) & also
        x, y = cls[ok], self.cls[j][ok]
        self.found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))

    def pairs(self) -> pa.Table:
        found = np.unique(np.concatenate(self.found), axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(found[:, 0])), "b": pa.array(np.ascontiguousarray(found[:, 1]))})


def first_round(lists: DataFrame, groups: int) -> DataFrame:
    """All pairs of short lists; of a long one, those of each chunk with the list's leaders and with the next ones in size."""

    @lean
    def small(t: pa.Table) -> pa.Table:
        m = _Members(t)
        begin, stop = np.array(m.runs, np.int64).reshape(-1, 2).T
        for size in np.unique(stop - begin).tolist():  # all lists of one size at once
            i, j = (((begin[stop - begin == size])[:, None] + k).ravel() for k in np.triu_indices(size, 1))
            m.add(m.cls[i], m.n[i], m.place[i], j)
        return m.pairs()

    @lean
    def large(t: pa.Table) -> pa.Table:
        m = _Members(t)
        every = np.arange(len(m.cls))
        for k in ("first", "second"):
            m.add(*(m.column(f"{k}_{c}") for c in ("cls", "n", "place")), every)
        for a, b in m.runs:
            m.add(m.cls[a : b - 1], m.n[a : b - 1], m.place[a : b - 1], every[a + 1 : b])
        return m.pairs()

    few = lists.where(F.col("size") <= SMALL).withColumns({"chunk": F.lit(0), "g": F.pmod(F.xxhash64("list"), F.lit(groups))})
    long = lists.where(F.col("size") > SMALL)
    # Leaders have few rarer shingles than this one: they are the least edited, and most like all others.
    own = F.struct("cls", "n", "place")
    leaders = checkpointed(long.groupBy("list").agg(F.min_by(own, F.struct("place", F.xxhash64("cls"))).alias("x"), F.min_by(own, F.struct("place", F.xxhash64("cls", "list"))).alias("y")), groups // 4)
    leaders = leaders.select("list", *[F.col(f"{s}.{c}").alias(f"{k}_{c}") for k, s in (("first", "x"), ("second", "y")) for c in ("cls", "n", "place")])
    long = long.join(leaders, "list").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / CHUNK)))
    long = long.withColumn("g", F.pmod(F.xxhash64("list", "chunk"), F.lit(groups)))
    return few.groupBy("g").applyInArrow(small, PAIRS_SQL).unionByName(long.groupBy("g").applyInArrow(large, PAIRS_SQL)).distinct()


def second_round(lists: DataFrame, parts: DataFrame, groups: int) -> DataFrame:
    """The pairs of long lists whose documents are in different components: every chunk against every chunk of those outside the list's largest component."""

    @lean
    def across(t: pa.Table) -> pa.Table:
        m = _Members(t)
        part, asks = m.column("part"), m.column("asks")
        for a, b in m.runs:
            members, others = a + np.flatnonzero(~asks[a:b]), a + np.flatnonzero(asks[a:b])
            step = max(1, AT_ONCE // max(1, len(members)))
            for k in range(0, len(others), step):
                i, j = np.repeat(others[k : k + step], len(members)), np.tile(members, len(others[k : k + step]))
                m.add(m.cls[i], m.n[i], m.place[i], j, part[i] != part[j])
        return m.pairs()

    long = lists.where(F.col("size") > SMALL).join(parts.withColumnRenamed("id", "cls"), "cls", "left").withColumn("part", F.coalesce("component_id", "cls"))
    of_list = long.groupBy("list", "part").agg(F.count("*").alias("k")).groupBy("list").agg(F.max_by("part", F.struct("k", "part")).alias("most"), (F.sum("k") - F.max("k")).alias("others"))
    mixed = checkpointed(of_list.where("others > 0").select("list", "most", F.ceil(F.col("others") / ACROSS).alias("asked")), groups // 4)
    long = long.join(mixed, "list").select("list", "cls", "n", "place", "part", (F.col("part") != F.col("most")).alias("other"), F.ceil(F.col("size") / CHUNK).alias("held"), "asked")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    columns = ["list", "cls", "n", "place", "part"]
    members = long.select(*columns, F.lit(False).alias("asks"), F.pmod(F.xxhash64("cls"), "held").alias("x"), F.explode(numbers("asked")).alias("y"))
    others = long.where("other").select(*columns, F.lit(True).alias("asks"), F.explode(numbers("held")).alias("x"), F.pmod(F.xxhash64("cls", "list"), "asked").alias("y"))
    rows = members.unionByName(others).select(*columns, "asks", F.xxhash64("x", "y").alias("chunk"))
    return rows.withColumn("g", F.pmod(F.xxhash64("list", "chunk"), F.lit(groups))).groupBy("g").applyInArrow(across, PAIRS_SQL).distinct()


class Index:
    """Inverted lists over the whole sets of a group: for each shingle the numbers of the sets that hold it, ascending."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes, self.ends = values, sizes.tolist(), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(values, kind="stable")
        token, self.owner = values[order], owner[order]
        self.begin = np.flatnonzero(_heads(token)) if len(token) else np.zeros(0, np.int64)
        self.tokens, self.stop = token[self.begin], np.append(self.begin[1:], len(token))

    def search(self, q: int) -> list[int]:
        """The other sets that share enough shingles with set q, by DivideSkip."""
        n = self.sizes[q]
        own = np.searchsorted(self.tokens, self.values[self.ends[q] - n : self.ends[q]])
        size = self.stop[own] - self.begin[own]
        own, size = own[size > 1], size[size > 1]  # the others hold q alone
        least = least_shared(n, -(-NUMERATOR * n // DENOMINATOR))  # T for the smallest partner
        if len(own) < least:
            return []
        by = np.argsort(size, kind="stable")
        lists = [self.owner[a:b].tolist() for a, b in zip(self.begin[own[by]].tolist(), self.stop[own[by]].tolist(), strict=True)]
        cut = len(lists) - (least - 1)
        short, long = lists[:cut], lists[cut:]
        out = []
        for c, run in groupby(heapq.merge(*short)):
            need = least_shared(n, self.sizes[c])
            have, left = sum(1 for _ in run), len(long)
            if c == q or DENOMINATOR * min(n, self.sizes[c]) < NUMERATOR * max(n, self.sizes[c]):
                continue
            for probe in long:
                if have >= need or have + left < need:
                    break
                i = bisect_left(probe, c)
                have += i < len(probe) and probe[i] == c
                left -= 1
            if have >= need:
                out.append(c)
        return out


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """A spanning forest of the links among the documents of each group: (a, b) brings b into a group of the query a, whose partners are dealt over groups in portions."""
    n, size = pairs.count(), texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-n // PAIRS_PER_GROUP), int(n * size) // BYTES_PER_GROUP)
    portions = checkpointed(pairs.groupBy("a").agg(F.count("*").alias("k")), groups // 4)
    asked = (
        pairs.join(portions, "a")
        .withColumn("portion", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PER_LEADER)))
        .select(F.pmod(F.xxhash64("a", "portion"), F.lit(groups)).alias("g"), "a", "b")
    )
    held = asked.select("g", F.col("a").alias("cls"), F.lit(True).alias("asks")).unionByName(asked.select("g", F.col("b").alias("cls"), F.lit(False).alias("asks")))
    rows = held.groupBy("g", "cls").agg(F.bool_or("asks").alias("asks")).join(texts, "cls")

    @lean
    def run(t: pa.Table) -> pa.Table:
        unpress, parts, left, right = zstandard.ZstdDecompressor().decompress, [], [], []
        data, offsets = text_bytes(pa.array([unpress(x.as_py()) for x in t["text"]], pa.large_binary()))
        for i, j in spans(offsets, BLOCK):
            parts.append(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        index, names = Index(*(np.concatenate(x) for x in zip(*parts, strict=True))), t["cls"].to_pylist()
        # A group's links are many where its documents are alike; a spanning forest connects as well.
        forest = Forest(len(names))
        for q in np.flatnonzero(t["asks"].to_numpy()).tolist():
            for c in index.search(q):
                if forest.join(q, c):
                    left.append(names[q])
                    right.append(names[c])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return checkpointed(rows.groupBy("g").applyInArrow(run, PAIRS_SQL), groups)


def _row_names(doc_key: str, text: Column, *names: str) -> list[Column]:
    return [F.xxhash64(doc_key, text).alias(names[0]), F.xxhash64(text, F.lit(1), doc_key).alias(names[1])]


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_rows of docs, and (cls, component_id) of sets that are linked with another one). Equal rows share a key of 128 bits, row and row2; equal sets a name of 64 bits, cls."""
    n = docs.count()
    buckets = max(1, -(-n // DOCS_PER_BUCKET))
    own = docs.select("doc_key", F.col("text").cast("binary").alias("text"), *_row_names("doc_key", F.col("text").cast("binary"), "row", "row2"))
    first = checkpointed(first_pass(own), n // DOCS_PER_FILE)
    often = docs.sparkSession.sparkContext.broadcast(sketch(first))
    sets = set_rows(first)
    lists = checkpointed(short_lists(postings(own, often, buckets)), 4 * buckets)
    # The texts of one document for each set that is on a list.
    needed = sets.groupBy("cls").agg(F.min("row").alias("row")).join(lists.select("cls").distinct(), "cls", "left_semi")
    texts = checkpointed(_pressed(own).join(needed, "row").select("cls", "text"), n // DOCS_PER_FILE)

    tested = checkpointed(first_round(lists, 4 * buckets), 4 * buckets)
    links = compare(tested, texts)
    parts = components(links, files=buckets)
    rest = checkpointed(second_round(lists, parts, 4 * buckets).join(tested, ["a", "b"], "left_anti"), 4 * buckets)
    more = compare(rest, texts)
    return sets, components(parts.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more), files=buckets)


def _pressed(own: DataFrame) -> DataFrame:
    """(row, text), compressed; a task gives equal rows once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            fresh = pa.array([not (x in seen or seen.add(x)) for x in batch.column(2).to_pylist()], pa.bool_())
            rows, texts = batch.column(2).filter(fresh), batch.column(1).filter(fresh)
            yield pa.RecordBatch.from_arrays([rows, pa.array([press.compress(x or b"") for x in texts.to_pylist()], pa.binary())], ["row", "text"])

    return own.mapInArrow(run, "row long, text binary")


#: Stands for a null doc_id, which Arrow's numbers don't have.
NO_ID = -(1 << 63)


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the component of their set, rows without words)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"), "text")
    sets, parts = classes(keyed)
    sets = sets.withColumn("doc_id", F.when(F.col("doc_key") != NO_ID, F.col("doc_key")))
    linked = sets.where("n_shingles > 0").join(parts.withColumnRenamed("id", "cls"), "cls", "left").withColumn("part", F.coalesce("component_id", "cls"))
    return linked, sets.where("n_shingles = 0")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Equal sets are one class, compared once. A text of null or without words has no shingles and is its own component, which
    is null where its doc_id is. Rows of a null doc_id lend no id to a component; rows of equal id stay rows of their own; an empty table
    gives no rows; further columns are ignored.
    """
    linked, without = _linked(docs)
    # Written out, so that the join below meets two plain exchanges and adaptive execution can split a large component.
    smallest = checkpointed(linked.groupBy("part").agg(F.min("doc_id").alias("smallest")))
    return (
        linked.join(smallest, "part").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))
        .unionByName(without.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns; documents without words stay. Rows of equal id and text are one."""
    linked, without = _linked(docs)
    own_key, *keys = fresh(docs, "doc_key", "row", "row2")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "row2")
    chosen = linked.groupBy("part").agg(F.min(order).alias("best")).select(*[F.col(f"best.{c}").alias(k) for c, k in zip(("row", "row2"), keys, strict=True)])
    kept = chosen.unionByName(without.select(*[F.col(c).alias(k) for c, k in zip(("row", "row2"), keys, strict=True)])).distinct()
    own = docs.withColumn(own_key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    own = own.select("*", *_row_names(own_key, F.col("text").cast("binary"), *keys))
    return own.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
