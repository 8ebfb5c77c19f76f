"""User callables over rows: loaded by path, in a process of their own with a time limit, tried again with delays, in batches."""

from __future__ import annotations

import json
import multiprocessing
import os
import subprocess
import tempfile
import time
import traceback
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Outcome(NamedTuple):
    """What a call gave, or the text of its error."""

    value: Any
    error: str | None


def with_retries(f: Callable, retries: int, delay: float = 0.0, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Outcome]:
    """Call again after an exception, after a delay that is multiplied each time (1: a fixed one). The last error is told."""

    def call(*args: Any) -> Outcome:
        error, wait = "", delay
        for k in range(retries + 1):
            try:
                return Outcome(f(*args), None)
            except Exception as e:  # noqa: BLE001  user code
                error = f"{type(e).__name__}: {e}"
            if k < retries and wait:
                sleep(wait)
                wait *= backoff
        return Outcome(None, error)

    return call


def isolated(f: Callable, timeout: float | None) -> Callable:
    """The call in a forked process, ended after the timeout: neither a crash nor a loop of user code takes the worker along."""

    def child(pipe: Any, args: tuple) -> None:
        try:
            pipe.send((f(*args), None))
        except BaseException as e:  # noqa: BLE001  told to the parent
            pipe.send((None, f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=-2)}"))
        finally:
            pipe.close()
            os._exit(0)

    def call(*args: Any) -> Any:
        fork = multiprocessing.get_context("fork")
        here, there = fork.Pipe(duplex=False)
        process = fork.Process(target=child, args=(there, args), daemon=True)
        process.start()
        there.close()
        try:
            if not here.poll(timeout):
                raise TimeoutError(f"no result after {timeout} seconds")
            try:
                value, error = here.recv()
            except EOFError:
                raise RuntimeError("the process ended without a result") from None
            if error:
                raise RuntimeError(error)
            return value
        finally:
            process.kill()
            process.join()
            here.close()

    return call


def by_path(evaluate: Callable[[str], Any], suffix: str = ".py") -> Callable[[str], tuple[dict, dict]]:
    """Code to (metrics, artifacts), by a callable that takes a file's path and gives a dict of metrics, or an object that has both. The file is on the worker's disk during the call only."""

    def call(code: str) -> tuple[dict, dict]:
        with tempfile.NamedTemporaryFile("w", suffix=suffix, encoding="utf-8") as file:
            file.write(code)
            file.flush()
            result = evaluate(file.name)
        if isinstance(result, dict):
            return result, {}
        return dict(result.metrics), dict(getattr(result, "artifacts", {}) or {})

    return call


def verified(pairs: DataFrame, verify: Callable[[dict], bool], timeout: float | None = 60.0, retries: int = 0) -> DataFrame:
    """Pairs (instance, solution, testing, and what verify needs, such as code and cases) with result and unknown_error.

    verify gets a row as a dict. What it raises, a missing side, or no answer in time is an unknown error and a false result. Without a
    timeout it runs in the worker itself, which is for callables that are trusted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(isolated(verify, timeout) if timeout else verify, retries)
        for pdf in batches:
            known = pdf["unknown_error"].fillna(False).tolist() if "unknown_error" in pdf else [False] * len(pdf)
            out = [Outcome(False, "missing") if skip else call(row) for row, skip in zip(pdf[names].to_dict("records"), known, strict=True)]
            yield pdf[names].assign(result=[o.error is None and bool(o.value) for o in out], unknown_error=[o.error is not None for o in out])

    base = pairs.drop("result", "unknown_error")
    names = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return pairs.drop("result").mapInPandas(run, f"{schema}, result boolean, unknown_error boolean")


def plain(value: Any) -> Any:
    """Numbers and arrays of numpy as plain ones, for JSON."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    return value.item() if isinstance(value, np.generic) else value


def processed(rows: DataFrame, process: Callable[[dict], Any], key: str, retries: int = 5, timeout: float | None = None, delay: float = 0.0, backoff: float = 1.0) -> DataFrame:
    """(key, output, error): each row, as a dict, by a callable; its output as JSON. An error that stays is told instead of failing the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(isolated(process, timeout) if timeout else process, retries, delay, backoff)
        for pdf in batches:
            out = [call(row) for row in pdf.to_dict("records")]
            yield pd.DataFrame({key: pdf[key], "output": [None if o.error else json.dumps(plain(o.value), ensure_ascii=False, sort_keys=True) for o in out], "error": [o.error for o in out]})

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, output string, error string")


def judged(rows: DataFrame, command: list[str], key: str = "id", code: str = "code", timeout: float = 600.0) -> DataFrame:
    """(key, output, error, score, done, correct, total): each program on the standard input of an external judge, and the counts of its report (null if it has none)."""
    from evoframe.functions.text import judge_summary

    def judge(text: str) -> str:
        done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"exit {done.returncode}: {done.stderr[-500:]}")
        return done.stdout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(judge, 0)
        for pdf in batches:
            out = [call(text) for text in pdf[code]]
            yield pd.DataFrame({key: pdf[key], "output": [o.value for o in out], "error": [o.error for o in out]})

    told = rows.select(key, code).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, output string, error string")
    return told.withColumn("_s", judge_summary(F.col("output"))).select(key, "output", "error", "_s.score", "_s.done", "_s.correct", "_s.total")


def batched(rows: DataFrame, respond: Callable[[list[str]], list[str]], key: str, size: int = 32, delay: float = 1.0, text: str = "prompt") -> DataFrame:
    """(key, reply): texts by batches, with a pause of each task between its batches, for services that limit their rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        called = False
        for pdf in batches:
            for a in range(0, len(pdf), size):
                if called and delay:
                    time.sleep(delay)
                called, part = True, pdf.iloc[a : a + size]
                yield pd.DataFrame({key: part[key], "reply": respond(part[text].tolist())})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, reply string")


def packings(programs: DataFrame, run_packing: Callable[[str], tuple[Any, Any, float]], timeout: float | None = 600.0) -> DataFrame:
    """programs: id, code. (grp, idx, x, y, r, reported_sum): circles that each program's packing gives; a program that fails gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(isolated(run_packing, timeout), 0)
        for pdf in batches:
            out = []
            for i, code in zip(pdf["id"], pdf["code"], strict=True):
                done = call(code)
                if done.error is None:
                    centers, radii, total = done.value
                    out += [(i, k, float(x), float(y), float(r), float(total)) for k, ((x, y), r) in enumerate(zip(centers, radii, strict=True))]
            yield pd.DataFrame(out, columns=["grp", "idx", "x", "y", "r", "reported_sum"])

    return programs.select("id", "code").mapInPandas(run, f"grp {programs.schema['id'].dataType.simpleString()}, idx long, x double, y double, r double, reported_sum double")
