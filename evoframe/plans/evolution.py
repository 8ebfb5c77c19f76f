"""Evolution over islands: sample, prompt, generate, parse, evaluate, add, migrate, write checkpoints, resume.

A driver loop over immutable DataFrames. Prompts are column expressions, user callables run in mapInPandas on the executors, the
population is kept by windows, joins and bounded folds. Only scalars come to the driver (ids, generations, a best score); each step
cuts its lineage by a reliable checkpoint. A step makes a batch of children of the current island; with one child it does
what a one-by-one loop would.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.functions import text as T
from evoframe.functions.metrics import hash_order
from evoframe.operators import population as P
from evoframe.plans.prompts import Sampler, sampled_prompts
from evoframe.plans.user_code import isolated, with_retries
from evoframe.sources import storage as S

PROGRAMS = (
    "id string, code string, language string, parent_id string, generation long, island long, seq long, iteration_found long, "
    "metrics map<string,double>, parent_metrics map<string,double>, changes string, artifacts map<string,string>"
)
COLUMNS = [c.split()[0] for c in PROGRAMS.split(", ")]
CELLS, ARCHIVE = "cell string, id string", "seq long, id string, fit double, best_fit double"

Evaluate = Callable[[str], Any]
Respond = Callable[[str, str], str]


@dataclass(frozen=True)
class Settings:
    iterations: int = 100
    population: int = 1000
    archive: int = 100
    islands: int = 5
    children: int = 1
    dimensions: tuple[str, ...] = ("score", "complexity")
    bins: int = 10
    exploration: float = 0.2
    exploitation: float = 0.7
    elite: float = 0.1
    inspirations: int = 5
    migration_interval: int = 50
    migration_rate: float = 0.1
    max_code: int = 10_000
    diffs: bool = True
    retries: int = 3
    delay: float = 1.0
    timeout: float | None = 300.0
    checkpoint_interval: int = 10
    target: float | None = None
    seed: str = "42"
    sampler: Sampler = field(default_factory=Sampler)

    @property
    def budget(self) -> int:
        """Steps of an island before the next one's turn."""
        return max(1, self.iterations // (self.islands * 10))


@dataclass(frozen=True)
class State:
    """programs, the champions' cells and the archive are tables; the rest are scalars."""

    programs: DataFrame
    cells: DataFrame
    archive: DataFrame
    best_id: str | None = None
    best_fit: float | None = None
    iteration: int = 0
    island: int = 0
    generations: tuple[int, ...] = ()
    last_migration: int = 0


def empty(spark: SparkSession, settings: Settings) -> State:
    return State(spark.createDataFrame([], PROGRAMS), spark.createDataFrame([], CELLS), spark.createDataFrame([], ARCHIVE), generations=(0,) * settings.islands)


def set_island(state: State, island: int) -> State:
    return replace(state, island=island % len(state.generations))


def next_island(state: State) -> State:
    return set_island(state, state.island + 1)


def grown(state: State) -> State:
    """The current island's generation goes up by one."""
    return replace(state, generations=tuple(g + (i == state.island) for i, g in enumerate(state.generations)))


def migration_due(state: State, settings: Settings) -> bool:
    return max(state.generations) - state.last_migration >= settings.migration_interval


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def added(state: State, arrivals: DataFrame, settings: Settings) -> State:
    """arrivals, in the order of seq: store, limit, cell, archive, best. Tables that depend on a program lose it when the limit takes it."""
    arrivals = _kept(arrivals.select(*COLUMNS))
    programs = _kept(P.limited(state.programs.unionByName(arrivals), settings.population, state.best_id).select(*COLUMNS))
    new = programs.join(arrivals.select("id"), "id", "left_semi")
    # A cell's champion gives way only to a strictly better arrival: the order of seq settles ties for the earlier one.
    held = P.scored(programs).join(state.cells, "id").select("cell", "id", "best_fit", "seq", F.lit(0).alias("new"))
    placed = P.scored(P.grid(programs, settings.dimensions, settings.bins, of=new)).select("cell", "id", "best_fit", "seq", F.lit(1).alias("new"))
    cells = held.unionByName(placed).groupBy("cell").agg(F.max_by("id", F.struct("best_fit", -F.col("new"), -F.col("seq"))).alias("id"))
    living = P.cascade_delete(state.archive.withColumnRenamed("id", "program_id"), programs).withColumnRenamed("program_id", "id")
    archive = P.archive_added(living, P.scored(new), settings.archive)
    best = P.scored(new).agg(F.max_by(F.struct("id", "best_fit"), F.struct("best_fit", -F.col("seq"))).alias("b")).first()["b"]
    better = best is not None and (state.best_fit is None or best["best_fit"] > state.best_fit)
    return replace(
        state, programs=programs, cells=_kept(cells.select("cell", "id")), archive=_kept(archive),
        best_id=best["id"] if better else state.best_id, best_fit=best["best_fit"] if better else state.best_fit,
    )


def migrated(state: State, settings: Settings) -> State:
    """Copies of each island's best go to its neighbours in the ring; they join programs and islands only."""
    if settings.islands > 1:
        m = P.migrants(state.programs, settings.islands, settings.migration_rate)
        copies = m.select(
            F.concat("id", F.lit("_migrant_"), F.col("target").cast("string")).alias("id"), "code", "language", F.col("id").alias("parent_id"), "generation",
            F.col("target").alias("island"), "seq", "iteration_found", "metrics", "parent_metrics", "changes", "artifacts",
        )
        # A copy that has been made before is made anew.
        rest = state.programs.join(copies.select("id"), "id", "left_anti")
        state = replace(state, programs=_kept(rest.unionByName(copies).select(*COLUMNS)))
    return replace(state, last_migration=max(state.generations))


def _unit(*parts: object) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def sampled_parents(state: State, settings: Settings, iteration: int) -> list[str]:
    """Ids of a step's parents, each by a policy: one of the island (which takes the best program if it is empty), one of the archive, of this island if there is any, or one of all.

    One aggregation answers all; they are as many as a step's children.
    """
    rows = state.programs.join(state.archive.select("id", F.lit(True).alias("_elite")), "id", "left")
    here, elite = F.col("island") == state.island, F.coalesce("_elite", F.lit(False))
    picks = []
    for k in range(settings.children):
        u, order = _unit(settings.seed, "policy", iteration, k), hash_order(f"{settings.seed}|{iteration}|{k}", F.col("id"))
        least = lambda keep, order=order: F.min_by("id", F.when(keep, order))
        any_one = F.min_by("id", order)
        if u < settings.exploration:
            pick = F.coalesce(least(here), F.lit(state.best_id).cast("string"), any_one)
        elif u < settings.exploration + settings.exploitation:
            pick = F.coalesce(least(elite & here), least(elite), any_one)
        else:
            pick = any_one
        picks.append(pick.alias(f"p{k}"))
    return [x for x in rows.agg(*picks).first() if x is not None]


def step_prompts(state: State, parents: list[str], settings: Settings, iteration: int) -> DataFrame:
    """(id, system, prompt) of each ask: a parent with its last three best programs as history and its inspirations as examples."""
    spark = state.programs.sparkSession
    asks = spark.createDataFrame([(f"{k}", p) for k, p in enumerate(parents)], "ask string, parent_id string")
    own = asks.join(state.programs.select(F.col("id").alias("parent_id"), "code", "language", "metrics", "artifacts"), "parent_id").withColumnRenamed("ask", "id").drop("parent_id")
    best = P.top_programs(state.programs, 3).withColumn("seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "seq")).cast("long"))
    best = best.select("seq", "metrics", "parent_metrics", "changes", F.lit(0).alias("_one"))  # three rows
    tried = asks.select(F.col("ask").alias("id"), (F.length("ask") * 0).alias("_one")).join(best, "_one").drop("_one")
    grid = P.grid(state.programs, settings.dimensions, settings.bins).join(state.cells.select("id", F.lit(True).alias("champion")), "id", "left").withColumn("champion", F.coalesce("champion", F.lit(False)))
    tops = None
    for k, p in enumerate(parents):
        order = P.inspirations(state.programs, p, settings.inspirations, settings.elite, f"{settings.seed}|{iteration}|{k}", grid)
        places = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "id"))), lambda x: x["id"]).alias("ids")).select(F.lit(f"{k}").alias("ask"), F.posexplode("ids").alias("place", "_id"))
        tops = places if tops is None else tops.unionByName(places)
    tops = tops.join(state.programs.withColumnRenamed("id", "_id"), "_id").select(F.col("ask").alias("id"), (F.col("place") + 1).alias("place"), "code", "language", "metrics")
    return sampled_prompts(own, tried, tops, settings.sampler)


def _result(value: Any) -> tuple[dict[str, float], dict[str, str]]:
    metrics, artifacts = value if isinstance(value, tuple) else (value, {}) if isinstance(value, dict) else (value.metrics, getattr(value, "artifacts", None) or {})
    numbers = {str(k): float(v) for k, v in metrics.items() if isinstance(v, (int, float))}
    return numbers, {str(k): v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for k, v in artifacts.items()}


def evaluated(rows: DataFrame, evaluate: Evaluate, settings: Settings) -> DataFrame:
    """rows with code: metrics and artifacts by a callable (user_code.by_path for one that takes a path), isolated and tried again. What fails gets error = 0 and the message as artifacts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(isolated(lambda code: _result(evaluate(code)), settings.timeout) if settings.timeout else lambda code: _result(evaluate(code)), settings.retries, settings.delay)
        for pdf in batches:
            out = [call(code) for code in pdf["code"]]
            pdf["metrics"] = [{"error": 0.0} if o.error else o.value[0] for o in out]
            pdf["artifacts"] = [{"stderr": o.error, "failure_stage": "evaluation"} if o.error else o.value[1] for o in out]
            yield pdf

    base = rows.drop("metrics", "artifacts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInPandas(run, f"{schema}, metrics map<string,double>, artifacts map<string,string>")


def generated(prompts: DataFrame, respond: Respond, settings: Settings) -> DataFrame:
    """(id, reply) by a callable (system, prompt) to reply; a failed one has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(respond, settings.retries, settings.delay, 2.0)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "reply": [call(s, p).value for s, p in zip(pdf["system"], pdf["prompt"], strict=True)]})

    return prompts.mapInPandas(run, "id string, reply string")


def children(state: State, respond: Respond, evaluate: Evaluate, settings: Settings, iteration: int) -> DataFrame:
    """A step's children: replies parsed as edits or as a whole program, too long ones and empty ones left out, the others evaluated."""
    parents = sampled_parents(state, settings, iteration)
    asks = state.programs.sparkSession.createDataFrame([(f"{k}", p) for k, p in enumerate(parents)], "ask string, parent_id string")
    replies = _kept(generated(step_prompts(state, parents, settings, iteration), respond, settings)).withColumnRenamed("id", "ask")
    own = state.programs.select(F.col("id").alias("parent_id"), F.col("code").alias("_code"), "language", "generation", F.col("metrics").alias("parent_metrics"))
    rows = asks.join(replies, "ask").join(own, "parent_id").where("reply is not null")
    if settings.diffs:
        blocks = T.diff_blocks(F.col("reply"))
        rows = rows.where(F.size(blocks) > 0).withColumns({"code": T.apply_blocks(F.col("_code"), blocks), "changes": T.diff_summary(blocks)})
    else:
        tag = rows.select(F.coalesce("language", F.lit("python"))).first()
        rows = rows.withColumns({"code": T.fenced(F.col("reply"), tag[0] if tag else "python"), "changes": F.lit("Full rewrite")}).where("code <> ''")
    number = F.lit(iteration * settings.children) + F.col("ask").cast("long") + 1
    rows = rows.where(F.length("code") <= settings.max_code).select(
        F.concat(F.lit(f"i{iteration + 1}_"), "ask").alias("id"), "code", "language", "parent_id", (F.col("generation") + 1).alias("generation"),
        F.lit(state.island).cast("long").alias("island"), number.alias("seq"), F.lit(iteration + 1).cast("long").alias("iteration_found"), "parent_metrics", "changes",
    )
    return _kept(evaluated(rows, evaluate, settings).select(*COLUMNS))


def seeded(spark: SparkSession, code: str, evaluate: Evaluate, settings: Settings, language: str = "python") -> State:
    """A fresh state whose islands have one program, at iteration 0."""
    row = spark.createDataFrame([("seed", code, language, None, 0, 0, 0, 0, None, "")], "id string, code string, language string, parent_id string, generation long, island long, seq long, iteration_found long, parent_metrics map<string,double>, changes string")
    return added(empty(spark, settings), evaluated(row, evaluate, settings), settings)


def save(state: State, base: str) -> str:
    """checkpoint_<iteration>: programs, state, the best program's code and what is known of it."""
    c = S.Checkpoint(base, state.iteration)
    lists = state.programs.groupBy("island").agg(F.sort_array(F.collect_list("id")).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("island", "m"))).alias("m"))
    archive = state.archive.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("archive"))
    cells = state.cells.agg(F.map_from_entries(F.collect_list(F.struct("cell", "id"))).alias("feature_map"))
    key = lambda df: df.withColumn("_one", F.lit(0))
    members = F.array(*[F.coalesce(F.try_element_at("m", F.lit(i).cast("long")), F.array().cast("array<string>")) for i in range(len(state.generations))])
    rows = key(lists).join(key(archive), "_one").join(key(cells), "_one").select(
        "feature_map", members.alias("islands"), "archive", F.lit(state.best_id).cast("string").alias("best_program_id"), F.lit(state.iteration).alias("last_iteration"), F.lit(state.island).alias("current_island"),
        F.array(*[F.lit(g) for g in state.generations]).alias("island_generations"), F.lit(state.last_migration).alias("last_migration_generation"),
    )
    best = state.programs.where(F.col("id") == F.lit(state.best_id))
    c.write(state.programs, rows, best.select("id", "generation", F.col("iteration_found").alias("iteration"), F.lit(state.iteration).alias("current_iteration"), "parent_id", "metrics", "language", F.lit(time.time()).alias("saved_at")))
    S.write_files(best.select(F.lit("best_program.txt").alias("name"), F.col("code").cast("binary").alias("content")), f"{c.path}/best_code")
    return c.path


def resumed(spark: SparkSession, base: str, settings: Settings) -> State | None:
    """The state of the checkpoint with the greatest number; None without one. Members and cells without a program are left out."""
    last = S.latest_checkpoint(spark, base)
    if last is None:
        return None
    programs, row = S.Checkpoint(base, last).read(spark)
    programs, s = programs.select(*COLUMNS), row.first()
    cells = row.select(F.explode("feature_map").alias("cell", "id")).join(programs.select("id"), "id", "left_semi").select("cell", "id")
    kept = row.select(F.explode("archive").alias("id"))
    archive = P.scored(programs).join(kept, "id", "left_semi").select("seq", "id", "fit", "best_fit")
    best = P.scored(programs).where(F.col("id") == F.lit(s.best_program_id)).select("best_fit").first()
    generations = tuple(s.island_generations) if len(s.island_generations) == settings.islands else (0,) * settings.islands
    return State(programs, cells, archive, s.best_program_id, best and best[0], s.last_iteration, s.current_island, generations, s.last_migration_generation)


def evolved(spark: SparkSession, seed: str, respond: Respond, evaluate: Evaluate, settings: Settings, base: str | None = None, language: str = "python") -> State:
    """The state after the iterations, or after the step whose children reach the target's mean. With a base folder, a run goes on from its last checkpoint and writes its own."""
    state = resumed(spark, base, settings) if base else None
    state = state or seeded(spark, seed, evaluate, settings, language)
    turns = 0
    for i in range(state.iteration, settings.iterations):
        if turns >= settings.budget:
            state, turns = next_island(state), 0
        turns += 1
        born = children(state, respond, evaluate, settings, i)
        state = replace(grown(added(state, born, settings)), iteration=i + 1)
        if migration_due(state, settings):
            state = migrated(state, settings)
        if base and (i + 1) % settings.checkpoint_interval == 0:
            save(state, base)
        if settings.target is not None:
            mean = F.aggregate(F.map_values("metrics"), F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size("metrics"), F.lit(1))
            if (born.agg(F.max(mean)).first()[0] or float("-inf")) >= settings.target:
                break
    if base:
        save(state, base)
    return state


def best_program(state: State, margin: float = 0.02) -> dict | None:
    """The tracked best, unless another one's combined score is above its by more than the margin."""
    rows = state.programs.withColumn("_score", F.try_element_at("metrics", F.lit("combined_score")))
    top = rows.agg(F.max_by("id", F.struct("_score", -F.col("seq"))).alias("id"), F.max("_score").alias("score")).first()
    own = rows.where(F.col("id") == F.lit(state.best_id)).select("_score").first()
    chosen = top["id"] if top["score"] is not None and own and own[0] is not None and top["score"] > own[0] + margin else state.best_id
    row = state.programs.where(F.col("id") == F.lit(chosen)).first()
    return json.loads(json.dumps(row.asDict(recursive=True))) if row else None
