"""The evolution loop: a driver loop over immutable DataFrames with injected generation and evaluation.

Each step makes a batch of children on the executors (the callables run in mapInPandas) and folds them into the population with
window operators. Only scalars come to the driver; the lineage is cut by a reliable checkpoint after each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.functions.metrics import merged, passes
from evoframe.operators.population import best_program, limited
from evoframe.operators.relational import sampled_by

SCHEMA = "id long, code string, parent_id long, generation long, island long, seq long, metrics map<string,double>"


@dataclass(frozen=True)
class Settings:
    population: int = 1000
    islands: int = 3
    children: int = 2
    max_code: int = 10_000
    checkpoint_interval: int = 10
    target: float | None = None
    retries: int = 2


def with_retries(f: Callable, retries: int) -> Callable:
    """Call again after an exception; the last one becomes an error metric."""

    def call(*args):
        error: Exception | None = None
        for _ in range(retries + 1):
            try:
                return f(*args)
            except Exception as e:  # noqa: BLE001  user code
                error = e
        return {"error": 1.0, "_message": str(error)}

    return call


def evaluated(rows: DataFrame, evaluate: Callable[[str], dict[str, float]], retries: int = 0, column: str = "metrics") -> DataFrame:
    """Metrics of each row's code by a callable that maps code to numbers; other values are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(evaluate, retries)
        for pdf in batches:
            pdf[column] = [{k: float(v) for k, v in call(c).items() if isinstance(v, (int, float))} for c in pdf["code"]]
            yield pdf

    base = rows.drop(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInPandas(run, f"{schema}, {column} map<string,double>")


def cascade(rows: DataFrame, stages: list[tuple[Callable[[str], dict[str, float]], float]]) -> DataFrame:
    """Cheap stages first: a later stage only runs on rows that passed all before, and its metrics override theirs."""
    current, out = rows.withColumn("metrics", F.create_map().cast("map<string,double>")), None
    for k, (evaluate, threshold) in enumerate(stages):
        done = evaluated(current.withColumnRenamed("metrics", "_before"), evaluate)
        done = done.withColumn("metrics", merged(F.col("_before"), F.col("metrics"))).drop("_before").withColumn("stages", F.lit(k + 1))
        ok = passes(F.col("metrics"), threshold)
        stopped = done.where(~ok) if k + 1 < len(stages) else done
        out = stopped if out is None else out.unionByName(stopped)
        current = done.where(ok).drop("stages")
    return out


def generated(parents: DataFrame, generate: Callable[[str, int], str], settings: Settings, step: int) -> DataFrame:
    """Children of each parent, by a callable (code, number) to code; too long ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["code"] = [generate(c, int(k)) for c, k in zip(pdf["code"], pdf["child"], strict=True)]
            yield pdf

    asks = parents.select("code", F.col("id").alias("parent_id"), (F.col("generation") + 1).alias("generation"), "island", F.explode(F.sequence(F.lit(0), F.lit(settings.children - 1))).alias("child"))
    made = asks.mapInPandas(run, "code string, parent_id long, generation long, island long, child int")
    number = F.lit(step * settings.islands * settings.children) + F.col("island") * settings.children + F.col("child") + 1
    return made.where(F.length("code") <= settings.max_code).select((number).cast("long").alias("id"), "code", "parent_id", "generation", "island", number.cast("long").alias("seq"))


def evolve(
    seed: DataFrame, generate: Callable[[str, int], str], evaluate: Callable[[str], dict[str, float]], steps: int,
    settings: Settings | None = None, start: int = 0, on_checkpoint: Callable[[int, DataFrame], None] | None = None,
) -> DataFrame:
    """The population after the steps; zero steps leave the seed as it is. A resumed run starts at the step after its checkpoint."""
    settings = settings or Settings()
    population = seed
    for step in range(start, start + steps):
        parents = sampled_by(population, "island", 1, "id", f"parent{step}")
        children = evaluated(generated(parents, generate, settings, step), evaluate, settings.retries).select(*population.columns).checkpoint()
        best = best_program(population).first()
        population = limited(population.unionByName(children), settings.population, best["id"] if best else None).select(*seed.columns).checkpoint()
        if on_checkpoint and (step + 1) % settings.checkpoint_interval == 0:
            on_checkpoint(step + 1, population)
        if settings.target is not None and (children.agg(F.max(F.aggregate(F.map_values("metrics"), F.lit(0.0), lambda a, v: a + v) / F.size("metrics"))).first()[0] or 0) >= settings.target:
            break
    return population


def seeded(population: DataFrame, seed: DataFrame, iteration: int) -> DataFrame:
    """The seed joins only a fresh run: iteration 0 and an empty population."""
    return seed if iteration == 0 and population.isEmpty() else population
