"""Parents, children, and what a lineage view shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.metrics import metric


def edges(programs: DataFrame) -> DataFrame:
    """Parent to child, where the parent is there."""
    parents = programs.select(F.col("id").alias("source"))
    return programs.select(F.col("parent_id").alias("source"), F.col("id").alias("target")).join(parents, "source")


def island_nodes(islands: DataFrame, programs: DataFrame) -> DataFrame:
    """islands: island, members (array of ids); members without a program are left out."""
    return islands.select("island", F.explode("members").alias("id")).join(programs.drop("island"), "id")


def members(membership: DataFrame, programs: DataFrame) -> DataFrame:
    """membership: island, id, a row for each member; those without a program are left out."""
    return membership.join(programs.drop("island"), "id")


def children_stats(programs: DataFrame, key: str) -> DataFrame:
    value = metric(F.col("metrics"), key)
    return programs.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"), F.min(value).alias("low"), F.max(value).alias("high"))


def metric_rows(programs: DataFrame) -> DataFrame:
    return programs.select("id", F.explode("metrics").alias("key", "value"))


def metric_deltas(programs: DataFrame) -> DataFrame:
    """Child less parent for every metric both have, joined by parent and key."""
    own, parents = metric_rows(programs), metric_rows(programs).select(F.col("id").alias("parent_id"), "key", F.col("value").alias("parent_value"))
    return own.join(programs.select("id", "parent_id"), "id").join(parents, ["parent_id", "key"]).withColumn("delta", F.col("value") - F.col("parent_value"))


def attempt_trends(programs: DataFrame) -> DataFrame:
    """Each metric against its island's last two attempts (missing there: 0): improved above both, regressed below both."""
    w = Window.partitionBy("island").orderBy("seq")
    rows = programs.withColumns({"one": F.lag("metrics", 1).over(w), "two": F.lag("metrics", 2).over(w)}).where("two is not null")
    rows = rows.select("id", "one", "two", F.explode("metrics").alias("key", "value"))
    a, b = (F.coalesce(F.try_element_at(F.col(c), F.col("key")), F.lit(0.0)) for c in ("one", "two"))
    up, down = (F.col("value") > a) & (F.col("value") > b), (F.col("value") < a) & (F.col("value") < b)
    return rows.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(up, F.col("key")))), ",").alias("improved"), F.array_join(F.array_sort(F.collect_list(F.when(down, F.col("key")))), ",").alias("regressed")
    )


def metric_range(programs: DataFrame) -> DataFrame:
    """Smallest and largest finite value of each metric; (0, 1) where they are one."""
    finite = metric_rows(programs).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    out = finite.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") == F.col("high")
    return out.select("key", F.when(flat, 0.0).otherwise(F.col("low")).alias("low"), F.when(flat, 1.0).otherwise(F.col("high")).alias("high"))


def metric_names(programs: DataFrame) -> DataFrame:
    return programs.select(F.explode(F.map_keys("metrics")).alias("key")).distinct()


def summary(programs: DataFrame, key: str) -> DataFrame:
    value = metric(F.col("metrics"), key)
    return programs.agg(
        F.coalesce(F.max(value), F.lit(0.0)).alias("high"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count("*").alias("programs"),
        F.count_distinct("generation").alias("generations"), F.count_distinct("island").alias("islands"),
        F.min("generation").alias("first_generation"), F.max("generation").alias("last_generation"),
    )


def highlighted(programs: DataFrame, kind: str, key: str = "score", archive: DataFrame | None = None) -> DataFrame:
    """top: all that reach the highest value; first: generation 0; failed: an error metric; unset: no value; archive: its members."""
    value = metric(F.col("metrics"), key)
    if kind == "top":
        high = programs.agg(F.max(value).alias("high"))
        return programs.join(F.broadcast(high), value == F.col("high"), "left_semi")  # one row
    if kind == "archive":
        return programs.join(archive.select("id"), "id", "left_semi")
    rule = {"first": F.col("generation") == 0, "failed": F.map_contains_key("metrics", F.lit("error")), "unset": value.isNull() | F.isnan(value)}
    return programs.where(rule[kind])


def list_order(programs: DataFrame, by: str, key: str = "score") -> list[Column]:
    """The order of a list view: id, generation, island (missing: 0), or score (missing last), ties as they came."""
    first = {"id": F.col("id"), "generation": F.coalesce("generation", F.lit(0)), "island": F.coalesce("island", F.lit(0)), "score": metric(F.col("metrics"), key).desc_nulls_last()}[by]
    return [first, F.col("seq")]


def _with_one(programs: DataFrame, one: DataFrame) -> DataFrame:
    """Every program with the single row of `one`, by a key that isn't a constant, so that it is a hash join."""
    return programs.withColumn("_one", F.coalesce(F.size("metrics") * 0, F.lit(0))).join(one.withColumn("_one", F.lit(0)), "_one").drop("_one")


def node_radius(programs: DataFrame, key: str = "score", low: float = 10, high: float = 32) -> DataFrame:
    """The metric scaled linearly into [low, high] over the table; missing 5, no range the middle. The range joins as one row."""
    value = metric(F.col("metrics"), key)
    value = F.when(~F.isnan(value), value)
    span = programs.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = low + (value - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * (high - low)
    radius = F.when(value.isNull(), 5.0).when(F.col("_low") == F.col("_high"), (low + high) / 2).otherwise(scaled)
    return _with_one(programs, span).withColumn("radius", radius).drop("_low", "_high")


def metric_bar(programs: DataFrame, key: str = "score") -> DataFrame:
    """The metric's place in its range, within [0, 1]; 1 where there is no range."""
    value = metric(F.col("metrics"), key)
    span = metric_range(programs).where(F.col("key") == key).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.col("_low")) / (F.col("_high") - F.col("_low"))))
    return _with_one(programs.where(value.isNotNull()), span).withColumn("percent", share).drop("_low", "_high")


def undefined_groups(programs: DataFrame, key: str) -> DataFrame:
    """Programs without a value by generation and island."""
    return highlighted(programs, "unset", key).groupBy("generation", "island").agg(F.count("*").alias("n"))


def id_search(programs: DataFrame, part: str) -> DataFrame:
    return programs.where(F.contains(F.lower(F.col("id").cast("string")), F.lit(part.lower())))


def graph_json(programs: DataFrame, archive: DataFrame) -> DataFrame:
    """Rows of a lineage graph for a writer: kind and JSON."""
    nodes = programs.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "island", "generation", "metrics")).alias("json"))
    links = edges(programs).select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target")).alias("json"))
    kept = archive.select(F.lit("archive").alias("kind"), F.to_json(F.struct("id")).alias("json"))
    return nodes.unionByName(links).unionByName(kept)


def ancestors(programs: DataFrame, start: int | str) -> DataFrame:
    """A program and all its ancestors, with their distance (id, parent_id, depth): one join a level, from the few found last; a driver loop of as many steps as there are levels."""
    own = programs.select("id", "parent_id")
    level = own.where(F.col("id") == F.lit(start)).withColumn("depth", F.lit(0))
    out, depth = level, 0
    row = level.first()
    while row is not None and row["parent_id"] is not None:
        depth += 1
        level = own.where(F.col("id") == F.lit(row["parent_id"])).withColumn("depth", F.lit(depth))
        row = level.first()
        out = out.unionByName(level)
    return out


def graph_document(programs: DataFrame, archive: DataFrame, checkpoint: str = "") -> DataFrame:
    """One row, json: the lineage graph as one document (archive, nodes, edges, checkpoint_dir), for programs that fit a page."""
    nodes = programs.agg(F.array_sort(F.collect_list(F.struct("id", "parent_id", "island", "generation", "seq"))).alias("nodes"))
    links = edges(programs).agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("edges"))
    kept = archive.agg(F.array_sort(F.collect_list("id")).alias("archive"))
    key = lambda df: df.withColumn("_one", F.size(F.col(df.columns[0])) * 0)
    rows = key(nodes).join(key(links), "_one").join(key(kept), "_one")
    return rows.select(F.to_json(F.struct("archive", "nodes", "edges", F.lit(checkpoint).alias("checkpoint_dir"))).alias("json"))


PAGE = "<!DOCTYPE html>\n<html>\n<head><title>Lineage</title></head>\n<body>\n<div id=\"graph\"></div>\n<script type=\"module\" src=\"static/main.js\"></script>\n</body>\n</html>\n"


def static_page(json: Column, page: str = PAGE) -> Column:
    """The page with the data in front of its module, or else at the body's end; `</` in the data can't end the script."""
    data = F.concat(F.lit("<script>window.STATIC_DATA = "), F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit(";</script>\n"))
    at = page.find('<script type="module"')
    at = at if at >= 0 else page.find("</body>")
    return F.concat(F.lit(page[:at]), data, F.lit(page[at:]))


