"""Experiments: starter programs from problem tables, and their fan-out, split by split."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions.text import BLOCK_END, BLOCK_START
from evoframe.plans.user_code import isolated, plain, with_retries


def starter_program(name: Column, inputs: Column, output: Column, n_params: int = 10) -> Column:
    """inputs: array of (symbol, description). A linear model between the markers, with a line on what each column of x is."""
    notes = F.array_join(F.transform(inputs, lambda v, i: F.concat(F.lit("#   x[:, "), i.cast("string"), F.lit("]: "), v["symbol"], F.lit(" ("), v["description"], F.lit(")"))), "\n")
    terms = F.array_join(F.transform(inputs, lambda v, i: F.concat(F.lit("x[:, "), i.cast("string"), F.lit("] * params["), i.cast("string"), F.lit("]"))), " + ")
    body = F.when(F.size(inputs) > 0, terms).otherwise("np.full(x.shape[0], params[0])")
    return F.concat(
        F.lit("# "), name, F.lit(": predicts "), output, F.lit("\n"), F.coalesce(F.nullif(notes, F.lit("")), F.lit("#   no inputs")),
        F.lit(f"\nimport numpy as np\n\n\n# {BLOCK_START}\ndef func(x, params):\n    return "), body, F.lit(f"\n# {BLOCK_END}\n\n\nfunc.num_params = {n_params}\n"),
    )


def experiment_config(name: Column, inputs: Column, output: Column, iterations: int) -> Column:
    """A run's configuration as JSON."""
    text = F.concat(F.lit("Find a formula for "), output, F.lit(" from "), F.array_join(F.transform(inputs, lambda v: v["symbol"]), ", "))
    return F.to_json(F.struct(name.alias("name"), F.lit(iterations).alias("iterations"), text.alias("system_message")))


def generated(problems: DataFrame, iterations: int = 200) -> DataFrame:
    """problems: split, name, inputs, output. (split, problem, name, content): the files of each problem's folder, for sources.storage.write_files."""
    c = F.col
    program = starter_program(c("name"), c("inputs"), c("output"))
    files = F.array(F.struct(F.lit("initial_program.py").alias("f"), program.alias("text")), F.struct(F.lit("config.json").alias("f"), experiment_config(c("name"), c("inputs"), c("output"), iterations).alias("text")))
    rows = problems.select("split", c("name").alias("problem"), F.explode(files).alias("x"))
    return rows.select("split", "problem", F.concat_ws("/", "split", "problem", "x.f").alias("name"), c("x.text").cast("binary").alias("content"))


def fan_out(experiments: DataFrame, run: Callable[[dict], Any], splits: list[str], timeout: float | None = None, after: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """experiments: split and what run needs. Every experiment of a split is a task of its own; the next split starts when all have ended. (split, output, error)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(isolated(run, timeout) if timeout else run, 0)
        for pdf in batches:
            out = [call(row) for row in pdf.to_dict("records")]
            yield pd.DataFrame({"split": pdf["split"], "output": [None if o.error else json.dumps(plain(o.value), sort_keys=True) for o in out], "error": [o.error for o in out]})

    done = None
    for split in splits:
        own = experiments.where(F.col("split") == split)
        n = max(1, own.count())
        part = own.repartition(n).mapInPandas(work, "split string, output string, error string").checkpoint()  # eager: the barrier
        if after:
            after(split, part)
        done = part if done is None else done.unionByName(part)
    return done
