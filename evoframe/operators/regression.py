"""Regression metrics, trial scorecards and fits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def regression_metrics(rows: DataFrame, by: str, y: str = "y", pred: str = "y_hat") -> DataFrame:
    """MSE, NMSE, R2, MAPE and count of each group without NaN predictions; degenerate groups give 0 or infinities."""
    d = F.col(y) - F.col(pred)
    used = rows.where(F.col(pred).isNotNull() & ~F.isnan(pred))
    out = used.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.var_pop(y).alias("_var"), F.sum(d * d).alias("_rss"),
        F.avg(F.when(F.col(y) != 0, F.abs(d / F.col(y)))).alias("_mape"),
    )
    zero = F.col("_var") == 0
    return out.select(
        by, "n", "mse",
        F.when(zero, F.when(F.col("mse") == 0, 0.0).otherwise(INF)).otherwise(F.try_divide("mse", "_var")).alias("nmse"),
        F.when(zero, F.when(F.col("_rss") == 0, 1.0).otherwise(-INF)).otherwise(1 - F.try_divide(F.col("_rss"), F.col("_var") * F.col("n"))).alias("r2"),
        F.coalesce("_mape", F.when(F.col("mse") == 0, 0.0).otherwise(INF)).alias("mape"),
    )


def _inversions(ranks: np.ndarray, weights: np.ndarray) -> int:
    """Weight of the pairs whose first rank is greater: bit by bit, the pairs that agree above it and differ in it."""
    total = 0
    for bit in range(int(ranks.max()).bit_length()):
        order = np.argsort(ranks >> (bit + 1), kind="stable")
        high, one, w = ranks[order] >> (bit + 1), (ranks[order] >> bit) & 1, weights[order]
        ones = np.cumsum(one * w)
        starts = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        before = np.repeat(np.append(0, ones)[starts], np.diff(np.append(starts, len(high))))
        total += int(np.sum((1 - one) * w * (ones - before)))
    return total


def _tau(y: np.ndarray, p: np.ndarray, weights: np.ndarray) -> float:
    """Tau-b of distinct pairs of values with their counts, in n log n."""
    if np.isnan(y).any():
        return float("nan")
    pairs = lambda n: int(np.sum(n * (n - 1) // 2))
    y, p = np.unique(y, return_inverse=True)[1], np.unique(p, return_inverse=True)[1]
    tied = lambda x: pairs(np.bincount(x, weights).astype(np.int64))
    order = np.lexsort((p, y))
    every = pairs(np.array([weights.sum()]))
    u, v = every - tied(y), every - tied(p)
    s = every - tied(y) - tied(p) + pairs(weights) - 2 * _inversions(p[order], weights[order])
    return s / (np.sqrt(u) * np.sqrt(v)) if u and v else float("nan")


def kendall_tau(rows: DataFrame, by: str, ordinal: str, y: str = "y", pred: str = "y_hat") -> DataFrame:
    """Tau-b of each whole group, without NaN predictions and nulls; under two rows, or without a spread, NaN. Equal pairs of values are counted
    first, so a group's distinct pairs are to fit in memory. The ordinal isn't needed: pairs have no order."""
    values = rows.where(~F.isnan(pred)).select(by, F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("p"))
    counts = values.where("y is not null and p is not null").groupBy(by, "y", "p").agg(F.count("*").alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [t[by].iloc[0]], "tau": [_tau(t["y"].to_numpy(), t["p"].to_numpy(), t["n"].to_numpy())]})

    tau = counts.groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, tau double")
    return values.select(by).distinct().join(tau, by, "left").na.fill(float("nan"), ["tau"])


def rolled_up(metrics: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Mean without infinities, median and count of each metric over groups; NaN is left out."""
    long = metrics.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select(by, "m.*")
    long = long.where("value is not null and not isnan(value)")
    finite = F.when(F.abs("value") < INF, F.col("value"))
    return long.groupBy("metric").agg(F.avg(finite).alias("mean"), F.percentile("value", 0.5).alias("median"), F.count("*").alias("n"))


def linear_fit(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least squares y = slope * x + intercept in one aggregation."""
    out = rows.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    return out


def multi_restart_fit(rows: DataFrame, by: str, n_params: int, restarts: int = 10, steps: int = 200, seed: int = 0) -> DataFrame:
    """Parameters of y = sum p_i x_i + p_last by descent from several seeded starts; the lowest loss stays, converged or not.

    Descent and loss need only the means of the columns' products, so a group of any size is one row. A loss far
    below the mean of y squared (by 1e-15) comes out as about zero. Rows with a null are left out.
    """
    k = n_params + 1
    last = F.when(F.size("x") > n_params, F.get("x", F.lit(n_params))).otherwise(F.lit(1.0))
    columns = [F.get("x", F.lit(i)).cast("double") for i in range(n_params)] + [last.cast("double"), F.col("y").cast("double")]
    names = [f"_{i}" for i in range(k + 1)]
    values = rows.select(by, *[c.alias(n) for c, n in zip(columns, names, strict=True)]).dropna(subset=names)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    means = values.groupBy(by).agg(F.array(*[F.avg(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("means"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.array(pairs).T
        for pdf in batches:
            params, mse = [], []
            for flat in pdf["means"]:
                m = np.zeros((k + 1, k + 1))
                m[upper[0], upper[1]] = m[upper[1], upper[0]] = flat
                curve, slope = m[:k, :k], m[:k, k]
                rate = 1.0 / max(np.linalg.eigvalsh(curve)[-1], 1e-12)
                p = np.random.default_rng(seed).standard_normal((restarts, k))
                for _ in range(steps):
                    p -= rate * (p @ curve - slope)
                ends = np.column_stack([p, -np.ones(restarts)])
                loss = np.maximum(np.einsum("ri,ij,rj->r", ends, m, ends), 0.0)
                best = int(np.argmin(loss))
                params.append(p[best].tolist())
                mse.append(float(loss[best]))
            yield pd.DataFrame({by: pdf[by], "params": params, "mse": mse})

    kind = rows.schema[by].dataType.simpleString()
    return means.mapInPandas(fit, f"{by} {kind}, params array<double>, mse double")


def bfgs(loss: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 200, tolerance: float = 1e-5) -> tuple[np.ndarray, float, bool]:
    """(parameters, loss, converged) by quasi-Newton steps with an inverse curvature that each step updates; gradients by differences, steps halved until the loss falls enough."""

    def slope(p: np.ndarray) -> np.ndarray:
        h = 1.5e-8 * np.maximum(1.0, np.abs(p))
        return np.array([(loss(p + step) - here) / size for step, size in zip(np.diag(h), h, strict=True)])

    p, here = start.astype(float), float(loss(start))
    inverse, g = np.eye(len(p)), None
    for _ in range(steps):
        g = slope(p) if g is None else g
        if not np.isfinite(g).all() or np.abs(g).max() <= tolerance:
            break
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(len(p)), -g
        rate, down = 1.0, float(d @ g)
        while rate > 1e-12 and not (new := float(loss(p + rate * d))) <= here + 1e-4 * rate * down:
            rate /= 2
        if rate <= 1e-12:
            break
        s = rate * d
        p, here = p + s, new
        after = slope(p)
        y = after - g
        if (sy := s @ y) > 1e-12:
            left = np.eye(len(p)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
        g = after
    return p, here, bool(g is not None and np.isfinite(g).all() and np.abs(g).max() <= tolerance)


def function_fit(rows: DataFrame, by: str, func: Callable[[np.ndarray, np.ndarray], np.ndarray], n_params: int, restarts: int = 10, seed: int = 0) -> DataFrame:
    """(by, params, mse, converged, error): a user's func(x, params) fitted to each group by BFGS from several seeded starts in [0, 1).

    The lowest loss stays, converged or not; a func that raises ends its group with the error. rows: by, x (array), y. An arbitrary
    function needs all of a group's rows at every step, so a group has to fit in a task; a linear one is better fitted by multi_restart_fit.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(pdf["x"]).astype(float), pdf["y"].to_numpy(float)

        def loss(p: np.ndarray) -> float:
            value = float(np.mean((np.asarray(func(x, p), float) - y) ** 2))
            return value if np.isfinite(value) else float("inf")

        best, rng, error = (None, INF, False), np.random.default_rng([seed, zlib.crc32(str(pdf[by].iloc[0]).encode())]), None
        for _ in range(restarts):
            try:
                found = bfgs(loss, rng.random(n_params))
            except Exception as e:  # noqa: BLE001  user code
                best, error = (None, INF, False), f"{type(e).__name__}: {e}"
                break
            best = found if found[1] < best[1] else best
        return pd.DataFrame({by: [pdf[by].iloc[0]], "params": [None if best[0] is None else best[0].tolist()], "mse": [best[1]], "converged": [best[2]], "error": [error]})

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, "x", "y").groupBy(by).applyInPandas(fit, f"{by} {kind}, params array<double>, mse double, converged boolean, error string")


def objective(x: Column, y: Column) -> Column:
    return F.sin(x) * F.cos(y) + F.sin(x * y) + (x * x + y * y) / 20


def valid_trial(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != INF)


def trial_scorecard(trials: DataFrame, by: str, target: float, x0: float, y0: float) -> DataFrame:
    """Scores of each group of trials (trial, x, y, value, seconds); failed trials only count against reliability.

    Both spread scores use x, as the original scorecard does; the overall score looks at the last valid trial's distance.
    """
    ok = valid_trial(F.col("value"))
    distance = F.hypot(F.col("x") - x0, F.col("y") - y0)
    when = lambda c: F.when(ok, c)
    out = trials.groupBy(by).agg(
        F.count_if(ok).alias("_ok"), F.count("*").alias("_all"), F.avg(when(F.col("value"))).alias("_value"), F.avg(when(distance)).alias("_distance"),
        F.avg(when(F.col("seconds"))).alias("_seconds"), F.stddev_pop(when(F.col("x"))).alias("_spread"), F.max_by(distance, when(F.col("trial"))).alias("_last"),
    ).where("_ok > 0")
    out = out.select(
        by,
        (1 / (1 + F.abs(F.col("_value") - target))).alias("value_score"), (1 / (1 + F.col("_distance"))).alias("distance_score"),
        (1 / (1 + F.col("_spread"))).alias("standard_deviation_score"),
        (F.least(F.when(F.col("_seconds") > 0, 1 / F.col("_seconds")).otherwise(0.0), F.lit(10.0)) / 10).alias("speed_score"),
        (F.col("_ok") / F.col("_all")).alias("reliability_score"),
        F.when(F.col("_last") < 1, 1.0).when(F.col("_last") < 3, 0.5).otherwise(0.1).alias("quality"),
    )
    combined = 0.35 * F.col("value_score") + 0.35 * F.col("distance_score") + 0.20 * F.col("standard_deviation_score") + 0.05 * F.col("speed_score") + 0.05 * F.col("reliability_score")
    return out.withColumn("combined_score", combined).withColumn("overall_score", 0.8 * F.col("quality") + 0.2 * F.col("combined_score")).drop("quality")
