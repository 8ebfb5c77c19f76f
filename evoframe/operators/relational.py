"""Resume, reuse, replication, quotas and sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.metrics import hash_order
from evoframe.session import kept


def unfinished(tasks: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Tasks whose id, as text, isn't among the finished ones."""
    done = finished.select(F.col(key).cast("string").alias("_done"))
    return tasks.join(done, tasks[key].cast("string") == F.col("_done"), "left_anti")


def released(rows: DataFrame, release: str, column: str, low: object | None = None, high: object | None = None) -> DataFrame:
    """Rows of a release whose date (or number) lies in a half-open range; both conditions reach the scan."""
    out = rows.where(F.col("release") == release)
    if low is not None:
        out = out.where(F.col(column) >= F.lit(low))
    return out if high is None else out.where(F.col(column) < F.lit(high))


def only(tasks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return tasks.join(wanted.select(key).distinct(), key, "left_semi")


def replicated(tasks: DataFrame, n: int, name: str = "copy") -> DataFrame:
    return tasks.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def reused(cached: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Cached rows, and fresh ones of keys without any."""
    return cached.unionByName(fresh.join(cached.select(key).distinct(), key, "left_anti"))


def skipped(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The rows after the first n, in order. An offset would take all rows into one task: here the sorted rows are kept with their places in their partitions, whose sizes tell where the n end."""
    placed = kept(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    for part in sorted(placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()):
        if n < part["n"]:
            return placed.where(F.col("_at") >= (part["p"] << 33) + n).drop("_at")
        n -= part["n"]
    return placed.where(F.lit(False)).drop("_at")


def point_lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key wins."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def quota_by_source(rows: DataFrame, title: str, source: str, arrival: str, quota: int) -> DataFrame:
    """The first `quota` of each source among titles not seen before (by source, then arrival)."""
    seen = Window.partitionBy(title).orderBy(source, arrival)
    first = rows.withColumn("_k", F.row_number().over(seen)).where("_k = 1").drop("_k")
    order = Window.partitionBy(source).orderBy(arrival)
    return first.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= quota)


def not_seen(rows: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Rows whose exact content isn't known; compared by hash, so no text is shuffled."""
    marked = rows.withColumn("_h", F.sha2(F.col(text), 256))
    return marked.join(known.select(F.sha2(F.col(text), 256).alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def numbered(rows: DataFrame, partition: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Dense numbers from 0 within each partition."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))


def _in_ranges(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """rows with _p, the number of their range of (by, order): ranges are as many as shuffles have partitions, so a frequent value of `by` has many. Their number is
    given, as adaptive execution would else be free to join them, each time in another way. The bounds come from a sample that each plan draws anew, so the rows
    are kept with their numbers: numbers of rows and of what is in front of them are of the same ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, by, *order).withColumn("_p", F.spark_partition_id()))


def _before(parts: DataFrame, by: str, what: Column, over: Callable[[str], Column]) -> DataFrame:
    """(_q, _by, _before): over the ranges of the same `by` in front of each one, of which there are as many as partitions."""
    w = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("_p", by).agg(what.alias("_what")).select(F.col("_p").alias("_q"), F.col(by).alias("_by"), over("_what").over(w).alias("_before"))


def ranked_within(rows: DataFrame, by: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """Numbers from 1 within each value of `by`, of which a few may hold all rows: counted range by range instead of in one task a value."""
    parts = _in_ranges(rows, by, *order)
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p", by).orderBy(*order)))
    out = local.join(_before(parts, by, F.count("*"), F.sum), (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_i")).cast("long")).drop("_p", "_q", "_by", "_i", "_before")


def so_far(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """The greatest value of all rows in front, within each value of `by`; null for the first. Ranges first, then what is in front of each."""
    parts = _in_ranges(rows, by, order)
    local = parts.withColumn("_m", F.max(value).over(Window.partitionBy("_p", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(_before(parts, by, F.max(value), F.max), (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn(name, F.greatest("_m", "_before")).drop("_p", "_q", "_by", "_m", "_before")


def numbered_all(rows: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """Dense numbers from 0 over the whole table without one task that sorts it all: range partitions, then their counts."""
    parts = _in_ranges(rows, order)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min(order).alias("_low"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return local.join(before, "_p").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_before", "_i")


def sampled(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows without replacement, the same on every run."""
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def sampled_by(rows: DataFrame, partition: str, n: int, key: str, seed: str) -> DataFrame:
    order = Window.partitionBy(partition).orderBy(hash_order(seed, F.col(key)), key)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def unit_interval(seed: str, key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / 4294967296.0


def weighted_choice(asks: DataFrame, models: DataFrame, key: str, seed: str) -> DataFrame:
    """Each ask draws a model with the share of its weight: an interval test against cumulative shares. models is a short list."""
    order = Window.orderBy("model")
    total = Window.partitionBy()
    high = F.sum("weight").over(order) / F.sum("weight").over(total)
    shares = models.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    shares = shares.agg(F.array_sort(F.collect_list(F.struct("high", "low", "model"))).alias("shares"))
    # One row, by a key that isn't a constant, so that it is a hash join.
    draw = asks.withColumns({"u": unit_interval(seed, F.col(key)), "_one": F.coalesce(F.length(F.col(key).cast("string")) * 0, F.lit(0))}).join(shares.withColumn("_one", F.lit(0)), "_one").drop("_one")
    pick = F.get(F.filter("shares", lambda s: (F.col("u") >= s["low"]) & (F.col("u") < s["high"])), F.lit(0))
    return draw.withColumn("model", pick["model"]).drop("shares")


def positional_zip(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    return left.join(right, ordinal)


def set_difference(all_ids: DataFrame, *gone: DataFrame) -> DataFrame:
    out = all_ids
    for g in gone:
        out = out.join(g, all_ids.columns[0], "left_anti")
    return out.distinct()


def set_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def slices(rows: DataFrame, ordinal: str, *ranges: tuple[int, int]) -> DataFrame:
    """Rows whose ordinal lies in any half-open range, in the ranges' order."""
    out = None
    for k, (a, b) in enumerate(ranges):
        part = rows.where((F.col(ordinal) >= a) & (F.col(ordinal) < b)).withColumn("slice", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def action_pairs(events: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each event with the one that answers it."""
    w = Window.partitionBy(conversation).orderBy(order)
    return events.withColumns({"next_turn": F.lead(order).over(w), "next_role": F.lead("role").over(w), "observation": F.lead("text").over(w)})


def last_answer(events: DataFrame, role: str = "assistant") -> DataFrame:
    """The text of a conversation's last event of a role."""
    return events.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))


def recent(rows: DataFrame, partition: str, order: str, n: int) -> DataFrame:
    """The last n of each partition, newest first; number counts from the partition's start."""
    down, up = Window.partitionBy(partition).orderBy(F.desc(order)), Window.partitionBy(partition).orderBy(order)
    out = rows.withColumns({"back": F.row_number().over(down).cast("long"), "number": F.row_number().over(up).cast("long")})
    return out.where(F.col("back") <= n)


def continue_or_exit(events: DataFrame, answered: Column) -> DataFrame:
    """/exit once the last agent event has an answer; after two user messages the reply offers to give up."""
    users = F.count_if(F.col("role") == "user")
    last = F.max_by(answered, F.when(F.col("role") == "assistant", F.col("turn")))
    reply = F.when(F.coalesce(last, F.lit(False)), "/exit").when(users >= 2, "continue, or give up").otherwise("continue")
    return events.groupBy("conv_id").agg(users.alias("user_messages"), reply.alias("reply"))
