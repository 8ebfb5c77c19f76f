"""Operators over the verification table: instance, solution, testing, result, unknown_error, ground.

One row per pair of a solution and a test of an instance. Every grouping starts with the instance, so partial aggregation runs
before each shuffle and consecutive windows over (instance, ...) reuse its partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS = "coalesce(result and not unknown_error, false)"


def passed() -> Column:
    return F.expr(PASS)


def cross_execute(solutions: DataFrame, testings: DataFrame) -> DataFrame:
    """Every solution of an instance against each of its tests: an equi-join of two many-sided relations."""
    return solutions.join(testings, "instance")


def verify_inputs(asked: DataFrame, solutions: DataFrame, testings: DataFrame) -> DataFrame:
    """What is asked, with code and cases; a missing side is an unknown error instead of a lost row."""
    return (
        asked.join(solutions, ["instance", "solution"], "left").join(testings, ["instance", "testing"], "left")
        .withColumn("unknown_error", F.col("code").isNull() | F.col("cases").isNull())
    )


def pass_lists(v: DataFrame) -> DataFrame:
    """Tests that each solution passes; solutions that pass none keep an empty list."""
    return v.groupBy("instance", "solution").agg(F.array_sort(F.collect_list(F.when(passed(), F.col("testing")))).alias("passed"))


def accept_lists(v: DataFrame) -> DataFrame:
    return v.groupBy("instance", "testing").agg(F.array_sort(F.collect_list(F.when(passed(), F.col("solution")))).alias("accepted"))


def pass_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("instance", "solution").agg(F.count_if(passed()).alias("weight"))


def accept_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("instance", "testing").agg(F.count_if(passed()).alias("weight"))


def discriminative_weights(v: DataFrame) -> DataFrame:
    """A test's mean quality of the solutions it accepts less that of those it rejects, an empty side counting 0."""
    one = Window.partitionBy("instance", "solution")
    scored = v.withColumn("quality", F.count_if(passed()).over(one) / F.count("*").over(one))
    side = lambda want: F.coalesce(F.avg(F.when(passed() == F.lit(want), F.col("quality"))), F.lit(0.0))
    return scored.groupBy("instance", "testing").agg((side(True) - side(False)).alias("weight"))


def _with_accepts(v: DataFrame) -> DataFrame:
    """Tests' accept counts and the instance's number of solutions beside each row, by windows over one partitioning."""
    test = Window.partitionBy("instance", "testing")
    return v.withColumns({"accepts": F.count_if(passed()).over(test), "solutions": F.count("*").over(test)})


def solution_weights(v: DataFrame, strategy: str) -> DataFrame:
    """(instance, solution, weight) by a named strategy.

    tfidf: sum of ln(M / (1 + accepts)) over passed tests; inverse: of 1 / accepts; hardness: of the share of solutions
    that a passed test rejects; coverage: distinct passed tests.
    """
    if strategy == "baseline":
        return pass_counts(v).withColumn("weight", F.col("weight").cast("double"))
    if strategy == "coverage":
        return v.groupBy("instance", "solution").agg(F.count_distinct(F.when(passed(), F.col("testing"))).cast("double").alias("weight"))
    terms = {
        "tfidf": F.log(F.col("solutions") / (1 + F.col("accepts"))),
        "inverse": F.try_divide(F.lit(1.0), F.col("accepts")),
        "hardness": 1 - F.col("accepts") / F.col("solutions"),
    }
    total = F.coalesce(F.sum(F.when(passed(), terms[strategy])), F.lit(0.0))
    return _with_accepts(v).groupBy("instance", "solution").agg(total.alias("weight"))


def ranked(weights: DataFrame, item: str) -> DataFrame:
    """Rank from 1 by weight, highest first; equal weights (to six digits) keep the items' order."""
    order = Window.partitionBy("instance").orderBy(F.round("weight", 6).desc(), F.col(item))
    return weights.withColumn("rank", F.row_number().over(order).cast("long"))


def ranked_arrays(ranks: DataFrame, item: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("rank", item)))
    return ranks.groupBy("instance").agg(F.transform(pairs, lambda p: p[item]).alias("items"))


Strategy = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
STRATEGIES: dict[str, Strategy] = {
    "baseline": lambda v: (ranked(pass_counts(v), "solution"), ranked(accept_counts(v), "testing")),
    "discriminative": lambda v: (ranked(pass_counts(v), "solution"), ranked(discriminative_weights(v), "testing")),
    **{
        name: (lambda v, name=name: (ranked(solution_weights(v, name), "solution"), ranked(accept_counts(v), "testing")))
        for name in ("tfidf", "inverse", "hardness", "coverage")
    },
}


def apply_strategy(v: DataFrame, name: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """Ranked solutions and ranked tests by a registered strategy."""
    return STRATEGIES[name](v)


def register_strategy(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def variance_report(v: DataFrame) -> DataFrame:
    """Whether each side's weights differ at all; an instance is kept if both do."""
    sides = [
        pass_counts(v).groupBy("instance").agg((F.min("weight") < F.max("weight")).alias("solutions_vary")),
        accept_counts(v).groupBy("instance").agg((F.min("weight") < F.max("weight")).alias("testings_vary")),
    ]
    return sides[0].join(sides[1], "instance").withColumn("keep", F.col("solutions_vary") & F.col("testings_vary"))


def _top_test(testings: DataFrame) -> DataFrame:
    return testings.where("rank = 1").select("instance", F.col("testing").alias("top_testing"))


def agreement_code(v: DataFrame, solutions: DataFrame, testings: DataFrame, s: int = 8) -> DataFrame:
    """The best solution passes the truth, and the top test agrees with the truth on the first and last s solutions."""
    sized = solutions.withColumn("n", F.count("*").over(Window.partitionBy("instance")))
    rows = (
        v.join(_top_test(testings), "instance").where("testing = top_testing")
        .join(sized.select("instance", "solution", "rank", "n"), ["instance", "solution"])
        .where((F.col("rank") <= s) | (F.col("rank") > F.col("n") - s))
        .withColumn("p", passed())
    )
    return rows.groupBy("instance").agg(
        F.min_by("solution", "rank").alias("correct_solution"), F.max_by("solution", "rank").alias("wrong_solution"), F.min("top_testing").alias("correct_testing"),
        F.min_by("ground", "rank").alias("ground_correct"), F.max_by("ground", "rank").alias("ground_wrong"),
        (F.min_by("ground", "rank") & F.bool_and(F.col("p") == F.col("ground"))).alias("result"),
    )


def agreement_os(v: DataFrame, solutions: DataFrame, testings: DataFrame, as_written: bool = False) -> DataFrame:
    """Best and worst solution under the top test and the truth; an unknown error of either gives no result."""
    last = solutions.withColumn("n", F.count("*").over(Window.partitionBy("instance"))).where("rank = 1 or rank = n")
    rows = v.join(_top_test(testings), "instance").where("testing = top_testing").join(last.select("instance", "solution", "rank"), ["instance", "solution"])
    best, worst = lambda c: F.min_by(c, "rank"), lambda c: F.max_by(c, "rank")
    same = worst("result") == worst("ground")
    verdict = same if as_written else best("ground") & best("result") & same
    return rows.groupBy("instance").agg(
        best("result").alias("positive"), worst("result").alias("negative"), best("ground").alias("ground_positive"), worst("ground").alias("ground_negative"),
        F.when(~F.bool_or("unknown_error"), verdict).alias("result"),
    )


def retention(v: DataFrame, solutions: DataFrame, testings: DataFrame) -> DataFrame:
    """Whether the top solution passes the top test."""
    top = solutions.where("rank = 1").select("instance", F.col("solution").alias("top_solution"))
    rows = v.join(_top_test(testings), "instance").where("testing = top_testing").join(top, "instance").where("solution = top_solution")
    return rows.select("instance", "solution", "testing", "unknown_error", F.when(~F.col("unknown_error"), F.col("result")).alias("kept"))


def scores(checks: DataFrame) -> DataFrame:
    """Share of true results, and of true ground results, among rows without an unknown error; null if there are none."""
    known = checks.where(~F.coalesce("unknown_error", F.lit(False)))
    return known.agg(F.count("*").alias("n"), F.avg(F.col("result").cast("int")).alias("final_score"), F.avg(F.col("ground").cast("int")).alias("answer_score"))


def status_counts(checks: DataFrame, by: str) -> DataFrame:
    """Successes, failures and errors by group, and the rate among what ran."""
    counts = checks.groupBy(by).agg(
        F.count_if(passed()).alias("succeeded"), F.count_if(~F.col("result") & ~F.col("unknown_error")).alias("failed"), F.count_if("unknown_error").alias("errors")
    )
    return counts.withColumn("rate", F.try_divide(F.col("succeeded").cast("double"), F.col("succeeded") + F.col("failed")))


def running_counts(checks: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The same counts as they stand after each row."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return checks.withColumns({"succeeded": F.count_if(passed()).over(so_far), "errors": F.count_if("unknown_error").over(so_far)})


def os_verdicts(rows: DataFrame) -> DataFrame:
    """One verdict per check of an operating-system task.

    Columns: type, testing (null if missing), solution (null if missing), answer, stdout, truth, comparison_method. A test of
    type QA compares the answer with its output, one of type EXEC wants exactly `true`; the truth compares with the stored answer.
    A missing side is false under a name of its own.
    """
    from evoframe.functions.text import answers_match

    method, answer = F.col("comparison_method"), F.col("answer")
    kind = F.when(F.col("solution").isNull(), "NO_SOLUTION_FOUND").when(F.col("testing").isNull(), "NO_TESTING_FOUND")
    verdict = (
        F.when(kind.isNotNull(), False)
        .when(F.col("testing") == "ground_truth", answers_match(method, answer, F.col("truth")))
        .when(F.col("type") == "QA", answers_match(method, answer, F.col("stdout")))
        .otherwise(F.coalesce(F.col("stdout") == "true", F.lit(False)))
    )
    return rows.withColumns({"error_kind": kind, "verdict": verdict})


def valid_instances(instances: DataFrame) -> DataFrame:
    """QA without, or EXEC with, a way to get the agent's result; others are marked WRONG."""
    good = ((F.col("type") == "QA") & F.col("get_agent_result").isNull()) | ((F.col("type") == "EXEC") & F.col("get_agent_result").isNotNull())
    good = F.coalesce(good, F.lit(False))
    return instances.withColumns({"valid": good, "type": F.when(good, F.col("type")).otherwise("WRONG")})
