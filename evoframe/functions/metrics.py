"""Expressions over metric maps (MAP<STRING,DOUBLE>)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(m: Column) -> Column:
    """Values that are neither null nor NaN; infinities stay."""
    return F.filter(F.map_values(m), lambda v: v.isNotNull() & ~F.isnan(v))


def safe_sum(m: Column) -> Column:
    return F.coalesce(F.aggregate(numbers(m), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))


def safe_average(m: Column) -> Column:
    """Mean of the numbers; 0 where there are none."""
    return F.coalesce(F.try_divide(safe_sum(m), F.size(numbers(m))), F.lit(0.0))


def metric(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def fitness(m: Column, key: str = "combined_score") -> Column:
    """The named metric, else the average of all."""
    return F.coalesce(metric(m, key), safe_average(m))


def without_error(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: (k != "error") & v.isNotNull())


def passes(m: Column, threshold: float) -> Column:
    """Mean of the metrics but `error` reaches the threshold; false for none, and for a NaN among them."""
    values = F.map_values(without_error(m))
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    return F.coalesce((mean >= threshold) & ~F.isnan(mean), F.lit(False))


def merged(*stages: Column) -> Column:
    """Later stages override earlier ones (the session's map policy is LAST_WIN); errors go."""
    return F.map_concat(*[without_error(s) for s in stages])


def feedback(m: Column, name: str = "llm_", weight: float = 1.0) -> Column:
    return F.transform_values(F.transform_keys(m, lambda k, v: F.concat(F.lit(name), k)), lambda k, v: v * weight)


def formatted(m: Column, pattern: str = "%s=%.4f", separator: str = ", ") -> Column:
    """Sorted by name; nan and inf in small letters, with a sign where the pattern has one."""
    entries = F.array_sort(F.map_entries(m))
    odd, sign = re.sub(r"%\+?\.\d+f", "%s", pattern), F.lit("+" if "%+" in pattern else "")
    v = lambda e: e["value"]
    name = lambda e: F.when(F.isnan(v(e)), F.concat(sign, F.lit("nan"))).when(v(e) == float("inf"), F.concat(sign, F.lit("inf"))).when(v(e) == float("-inf"), "-inf")
    one = lambda e: F.when(name(e).isNotNull(), F.format_string(odd, e["key"], name(e))).otherwise(F.format_string(pattern, e["key"], v(e)))
    return F.array_join(F.transform(entries, one), separator)


def improvement(parent: Column, child: Column) -> Column:
    """`k=+d` for every metric that both hold."""
    both = F.map_filter(F.map_zip_with(parent, child, lambda k, a, b: b - a), lambda k, d: d.isNotNull())
    return formatted(both, "%s=%+.4f")


def outcome(parent: Column, child: Column) -> Column:
    """All of the child's metrics above the parent's (missing: 0), all below, or mixed."""
    pairs = F.transform(F.map_entries(child), lambda e: F.struct(e["value"].alias("c"), F.coalesce(F.try_element_at(parent, e["key"]), F.lit(0.0)).alias("p")))
    up, down = F.forall(pairs, lambda x: x["c"] > x["p"]), F.forall(pairs, lambda x: x["c"] < x["p"])
    some = F.size(pairs) > 0
    return F.when(some & up, "Improvement in all metrics").when(some & down, "Regression in all metrics").otherwise("Mixed results")


def bin_of(x: Column, bins: int, clamp: bool = True) -> Column:
    """Grid coordinate of a value in [0, 1); without clamp negative values give negative bins."""
    out = F.least((x * bins).cast("long"), F.lit(bins - 1).cast("long"))
    return F.greatest(out, F.lit(0).cast("long")) if clamp else out


def complexity_bin(code: Column, bins: int) -> Column:
    return bin_of(F.length(code) / 1000.0, bins)


def cell_key(*bins: Column) -> Column:
    return F.concat_ws("-", *[b.cast("string") for b in bins])


def safe_double(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def log_error(mse: Column) -> Column:
    return -F.log10(mse + 1e-9)


def linear_model(x: Column, p: Column) -> Column:
    return F.aggregate(F.zip_with(x, p, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def hash_order(seed: str, key: Column) -> Column:
    """A fixed pseudo-random order, the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
