"""A population of programs: id, code, parent_id, generation, island, seq (order of arrival), metrics.

Bounded populations are kept by windows and semi-joins in batches. Where the result depends on the order of single
arrivals, a fold in one group is offered beside the batch form.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.metrics import bin_of, cell_key, complexity_bin, fitness, hash_order, metric, safe_average
from evoframe.functions.text import whole_edit_distance
from evoframe.operators.relational import ranked_within, so_far, unit_interval


def scored(programs: DataFrame) -> DataFrame:
    """fit: the average of all metrics, to nine digits; best_fit: the combined score where there is one."""
    return programs.withColumns({"fit": F.round(safe_average(F.col("metrics")), 9), "best_fit": F.round(fitness(F.col("metrics")), 9)})


def best_program(programs: DataFrame, key: str | None = None) -> DataFrame:
    """The best by a metric among those that have it; else by the combined score if all have one; else by the average. First come wins ties."""
    m = F.col("metrics")
    if key:
        rows = programs.where(F.map_contains_key(m, key)).withColumn("value", metric(m, key))
    else:
        every = programs.agg(F.bool_and(F.map_contains_key(m, F.lit("combined_score"))).alias("every"))
        value = F.when(F.col("every"), metric(m, "combined_score")).otherwise(F.round(safe_average(m), 9))
        # One row, by a key that isn't a constant, so that it is a hash join.
        rows = programs.withColumn("_one", F.coalesce(F.size("metrics") * 0, F.lit(0))).join(every.withColumn("_one", F.lit(0)), "_one").withColumn("value", value)
    return rows.agg(F.max_by("id", F.struct("value", -F.col("seq"))).alias("id"), F.max("value").alias("value"))


def top_programs(programs: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """The n best by a metric, or by the average (never by the combined score)."""
    m = F.col("metrics")
    rows = programs.where(F.map_contains_key(m, key)).withColumn("value", metric(m, key)) if key else programs.withColumn("value", F.round(safe_average(m), 9))
    return rows.orderBy(F.desc("value"), "seq").limit(n)


def compared(programs: DataFrame) -> DataFrame:
    """Ranks by one key: rows with metrics first, then combined score or average, then the newer."""
    some = F.size("metrics") > 0
    value = F.when(some, F.round(fitness(F.col("metrics")), 9))
    keyed = programs.withColumns({"_some": some, "_value": value})
    return ranked_within(keyed, "island", F.desc("_some"), F.desc_nulls_last("_value"), F.desc("seq")).drop("_some", "_value")


def limited(programs: DataFrame, n: int, best_id: str | int | None = None) -> DataFrame:
    """The n best stay, the protected one among them; of equals the later came stays. One pass of top-n, no global window."""
    safe = (F.col("id") == F.lit(best_id)) if best_id is not None else F.lit(False)
    return scored(programs).orderBy(safe.desc(), F.desc("fit"), F.desc("seq")).limit(n)


def cascade_delete(dependants: DataFrame, programs: DataFrame, key: str = "program_id") -> DataFrame:
    return dependants.join(programs.select(F.col("id").alias(key)), key, "left_semi")


def cells(programs: DataFrame, bins: int = 10, clamp: bool = True) -> DataFrame:
    """Grid coordinates by code length and average, and the cell's key."""
    out = programs.withColumns({"b0": complexity_bin(F.col("code"), bins), "b1": bin_of(F.round(safe_average(F.col("metrics")), 9), bins, clamp)})
    return out.withColumn("cell", cell_key(F.col("b0"), F.col("b1")))


def diversity_bins(programs: DataFrame, of: DataFrame, bins: int = 10, sample: int = 5, seed: str = "diversity") -> DataFrame:
    """of: programs to place. (id, bin) by the mean edit distance to a fixed sample of all programs, the program itself perhaps among them; 0 while there are fewer than the sample's size."""
    few = programs.select(F.col("code").alias("_other"), "id").orderBy(hash_order(seed, F.col("id")), "id").limit(sample)
    # At most `sample` codes, gathered in one row that joins by a key.
    few = few.groupBy().agg(F.collect_list("_other").alias("_sample")).withColumn("_one", F.lit(0))
    pairs = of.select("id", "code", (F.length(F.col("id").cast("string")) * 0).alias("_one")).join(few, "_one").select("id", "code", F.explode_outer("_sample").alias("_other"))
    mean = pairs.withColumn("_d", whole_edit_distance(F.col("code"), F.col("_other"))).groupBy("id").agg(F.avg("_d").alias("_mean"), F.count("_other").alias("_n"))
    return mean.select("id", F.when(F.col("_n") < sample, F.lit(0).cast("long")).otherwise(bin_of(F.col("_mean") / 1000.0, bins)).alias("bin"))


def grid(programs: DataFrame, dimensions: tuple[str, ...] = ("score", "complexity"), bins: int = 10, of: DataFrame | None = None) -> DataFrame:
    """The programs (or those of `of`) with b0, b1, ... and their cell: complexity, diversity, score, or a metric by name, whose lack is the middle bin."""
    rows, keys = programs if of is None else of, []
    m = F.col("metrics")
    for i, name in enumerate(dimensions):
        keys.append(f"b{i}")
        if name == "diversity":
            rows = rows.join(diversity_bins(programs, rows, bins).withColumnRenamed("bin", f"b{i}"), "id")
        else:
            value = {"complexity": complexity_bin(F.col("code"), bins), "score": F.when(F.size(m) > 0, bin_of(F.round(safe_average(m), 9), bins)).otherwise(F.lit(0).cast("long"))}.get(name)
            rows = rows.withColumn(f"b{i}", value if value is not None else F.when(metric(m, name).isNotNull(), bin_of(metric(m, name), bins)).otherwise(F.lit(bins // 2).cast("long")))
    return rows.withColumn("cell", cell_key(*[F.col(k) for k in keys]))


def champions(programs: DataFrame, bins: int = 10) -> DataFrame:
    """The best program of each cell; only a strictly better one would have replaced the first."""
    order = Window.partitionBy("cell").orderBy(F.desc("best_fit"), "seq")
    return scored(cells(programs, bins)).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def neighbour_cells(champions_: DataFrame) -> DataFrame:
    """Champions of cells that differ by at most one in each coordinate: an equi-join on the nine shifted cells."""
    near = F.explode(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.struct((F.col("b0") + i).alias("b0"), (F.col("b1") + j).alias("b1"))))))
    probes = champions_.select(F.col("id").alias("of_id"), F.col("cell").alias("of_cell"), near.alias("p")).select("of_id", "of_cell", "p.b0", "p.b1")
    return probes.join(champions_.select("id", "cell", "b0", "b1"), ["b0", "b1"]).where("cell <> of_cell")


def archive(programs: DataFrame, n: int) -> DataFrame:
    """The n fittest: what a bounded archive holds when its members arrive in a batch."""
    return scored(programs).orderBy(F.desc("best_fit"), "seq").limit(n)


def archive_fold(programs: DataFrame, n: int) -> DataFrame:
    """The archive after single arrivals: filled first, then the lowest average goes if the new one is better by the comparator.

    Order matters, so it is one group by nature; meant for one island's stream, with only three numbers a row.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return _folded(pdf.sort_values("seq"), n)[["island", "id"]]

    return scored(programs).select("island", "seq", "id", "fit", "best_fit").groupBy("island").applyInPandas(fold, "island long, id long")


def running_best(programs: DataFrame, partition: str = "island") -> DataFrame:
    """Arrivals that were strictly better than all before them."""
    rows = so_far(scored(programs), partition, "seq", "best_fit", "_so_far")
    return rows.where(F.col("_so_far").isNull() | (F.col("best_fit") > F.col("_so_far"))).drop("_so_far")


def island_stats(programs: DataFrame, islands: int) -> DataFrame:
    """Size, best, mean and newest generation of every island; empty ones have zeros."""
    stats = scored(programs).groupBy("island").agg(
        F.count("*").alias("size"), F.max("best_fit").alias("best"), F.avg("best_fit").alias("mean"), F.max("generation").alias("last_generation")
    )
    every = programs.sparkSession.range(islands).withColumnRenamed("id", "island")
    return every.join(stats, "island", "left").na.fill(0).na.fill(0.0)


def island_diversity(programs: DataFrame, sample: int = 10, most: int | None = None) -> DataFrame:
    """Mean edit distance of whole code (or of its first `most` characters) over all pairs of a fixed sample of each island; under two members 0."""
    order = Window.partitionBy("island").orderBy(hash_order("div", F.col("id")), "id")
    few = programs.select("island", "id", (F.left("code", F.lit(most)) if most else F.col("code")).alias("code"), F.row_number().over(order).alias("k")).where(F.col("k") <= sample)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.island") == F.col("b.island")) & (F.col("a.k") < F.col("b.k")))
    # The pairs are dealt out, as the islands are few and whole texts may be long.
    pairs = pairs.select(F.col("a.island").alias("island"), F.col("a.code").alias("code"), F.col("b.code").alias("other")).repartition("code", "other")
    mean = pairs.select("island", whole_edit_distance(F.col("code"), F.col("other")).alias("distance")).groupBy("island").agg(F.avg("distance").alias("diversity"))
    return few.select("island").distinct().join(mean, "island", "left").na.fill(0.0)


def migrants(programs: DataFrame, islands: int, rate: float, stamp: str = "t") -> DataFrame:
    """The best share of each island (one at least), copied to both ring neighbours (once, where these coincide)."""
    rows = ranked_within(scored(programs), "island", F.desc("best_fit"), "seq").join(programs.groupBy("island").agg(F.count("*").alias("n")), "island")
    chosen = rows.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * rate)))
    targets = F.array_distinct(F.array(F.pmod(F.col("island") + 1, F.lit(islands)), F.pmod(F.col("island") - 1, F.lit(islands))))
    return chosen.withColumn("target", F.explode(targets)).where("target <> island").withColumn(
        "new_id", F.concat(F.col("id").cast("string"), F.lit("_migrant_"), F.col("target").cast("string"), F.lit(f"_{stamp}"))
    )


def migration_due(state: DataFrame, interval: int) -> DataFrame:
    """state: island, generation, last_migration."""
    return state.agg((F.max("generation") - F.max("last_migration") >= interval).alias("due"), F.max("generation").alias("generation"))


def parent_policy(asks: DataFrame, key: str, explore: float = 0.2, exploit: float = 0.7, seed: str = "policy") -> DataFrame:
    u = unit_interval(seed, F.col(key))
    return asks.withColumn("policy", F.when(u < explore, "explore").when(u < explore + exploit, "exploit").otherwise("random"))


def sampled_parent(programs: DataFrame, seed: str) -> DataFrame:
    """A fixed random member of each island."""
    return programs.groupBy("island").agg(F.min_by("id", hash_order(seed, F.col("id"))).alias("id"))


def archive_parent(programs: DataFrame, archive_: DataFrame, island: int, seed: str) -> DataFrame:
    """A fixed random archive member, of this island if it has any."""
    rows = programs.join(archive_.select("id"), "id", "left_semi")
    order = hash_order(seed, F.col("id"))
    return rows.agg(F.coalesce(F.min_by("id", F.when(F.col("island") == island, order)), F.min_by("id", order)).alias("id"))


def inspirations(programs: DataFrame, parent_id: int | str, n: int, elite_ratio: float, seed: str, cells_: DataFrame | None = None) -> DataFrame:
    """The best, then the top share, then (given champions with their cells' b0, b1, ...) those of cells next to the parent's, then random others: n of them, without the parent, each once."""
    rows = scored(programs).where(F.col("id") != parent_id)
    elite = max(1, int(n * elite_ratio))
    best = rows.orderBy(F.desc("best_fit"), "seq").limit(1).select("id", F.lit(0).alias("priority"), F.lit("").alias("place"))
    top = rows.orderBy(F.desc("fit"), "seq").limit(elite).select("id", F.lit(1).alias("priority"), F.format_string("%020.9f", 1e9 - F.col("fit")).alias("place"))
    place = hash_order(seed, F.col("id"))
    pool = best.unionByName(top)
    if cells_ is not None:
        bins = [c for c in cells_.columns if c.startswith("b") and c[1:].isdigit()]
        own = cells_.where(F.col("id") == parent_id).select(*[F.col(b).alias(f"_{b}") for b in bins])
        near = own
        for b in bins:
            near = near.withColumn(f"_{b}", F.explode(F.array(*[F.col(f"_{b}") + d for d in (-1, 0, 1)])))
        keyed = cells_.where(cells_["champion"]).withColumn("_k", F.concat_ws("-", *bins))
        near = keyed.join(near.select(F.concat_ws("-", *[f"_{b}" for b in bins]).alias("_k")), "_k", "left_semi").where(F.col("id") != parent_id)
        pool = pool.unionByName(near.select("id", F.lit(2).alias("priority"), place.alias("place")).orderBy("place").limit(n))
    rest = rows.select("id", F.lit(3 if cells_ is not None else 2).alias("priority"), place.alias("place")).orderBy("place").limit(2 * n + elite + 1)
    pool = pool.unionByName(rest).groupBy("id").agg(F.min(F.struct("priority", "place")).alias("p"))
    return pool.orderBy("p", "id").limit(n).select("id", "p.priority")


def archive_added(held: DataFrame, arrivals: DataFrame, n: int) -> DataFrame:
    """held and arrivals: seq, id, fit, best_fit. The archive after the arrivals, one by one; both are bounded, by n and by a step's batch."""
    both = held.select("seq", "id", "fit", "best_fit", F.lit(0).alias("new")).unionByName(arrivals.select("seq", "id", "fit", "best_fit", F.lit(1).alias("new")))
    kind = both.schema["id"].dataType.simpleString()
    return both.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: _folded(pdf.sort_values(["new", "seq"]), n)[["seq", "id", "fit", "best_fit"]], f"seq long, id {kind}, fit double, best_fit double")


def _folded(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Filled first; then the lowest average goes if the arrival is better than it."""
    fit, best, held = rows["fit"].tolist(), rows["best_fit"].tolist(), []
    for k in range(len(rows)):
        if len(held) < n:
            held.append(k)
            continue
        worst = min(range(len(held)), key=lambda i: (fit[held[i]], i))
        if best[k] > best[held[worst]]:
            held[worst] = k
    return rows.iloc[held]


def final_choice(best: DataFrame, margin: float = 0.02) -> DataFrame:
    """tracked_id, tracked_score, best_id, best_score: the tracked one unless the other's combined score beats it by more than the margin."""
    return best.withColumn("chosen", F.when(F.col("best_score") > F.col("tracked_score") + margin, F.col("best_id")).otherwise(F.col("tracked_id")))
