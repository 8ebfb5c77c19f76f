"""Hand-checked fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from evoframe.functions import metrics as M
from evoframe.functions import text as T
from evoframe.operators import geometry as G
from evoframe.operators import population as P
from evoframe.operators import regression as E
from evoframe.operators import relational as R
from evoframe.operators import verification as V


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if not isinstance(v, (str, int, float)) else F.lit(v)).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def matrix(spark):
    rows = []
    for s, bits in enumerate(("111", "110", "100", "001")):
        rows += [(1, s, t, b == "1", False, b == "1") for t, b in enumerate(bits)]
    return spark.createDataFrame(rows, "instance long, solution long, testing long, result boolean, unknown_error boolean, ground boolean")


def test_counts_and_baseline_rank(matrix):
    solutions, testings = V.apply_strategy(matrix, "baseline")
    assert [(r.solution, r.weight) for r in solutions.orderBy("rank").collect()] == [(0, 3), (1, 2), (2, 1), (3, 1)]
    assert [(r.testing, r.weight) for r in testings.orderBy("rank").collect()] == [(0, 3), (1, 2), (2, 2)]


def test_discriminative_rank(matrix):
    weights = {r.testing: r.weight for r in V.discriminative_weights(matrix).collect()}
    assert weights == pytest.approx({0: 1 / 3, 1: 1 / 2, 2: 1 / 6})
    assert [r.testing for r in V.ranked(V.discriminative_weights(matrix), "testing").orderBy("rank").collect()] == [1, 0, 2]


@pytest.mark.parametrize(("bits", "keep", "one_side"), [(("11", "11"), False, False), (("00", "00"), False, False), (("11", "00"), False, True)])
def test_zero_variance(spark, bits, keep, one_side):
    rows = [(1, s, t, b == "1", False, False) for s, row in enumerate(bits) for t, b in enumerate(row)]
    v = spark.createDataFrame(rows, "instance long, solution long, testing long, result boolean, unknown_error boolean, ground boolean")
    r = V.variance_report(v).first()
    assert (r.keep, r.solutions_vary) == (keep, one_side)


def test_empty_score_is_null(matrix):
    r = V.scores(matrix.where("false")).first()
    assert (r.n, r.final_score) == (0, None)


def test_own_strategy(matrix):
    V.register_strategy("same", lambda v: (V.ranked(V.pass_counts(v).withColumn("weight", F.lit(1)), "solution"), V.ranked(V.accept_counts(v), "testing")))
    assert [r.solution for r in V.apply_strategy(matrix, "same")[0].orderBy("rank").collect()] == [0, 1, 2, 3]


def test_metric_average(spark):
    m = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(float("nan")), F.lit("d"), F.lit(True).cast("double"))
    assert one(spark, M.safe_average(m)) == 1.0
    assert one(spark, M.safe_average(F.create_map().cast("map<string,double>"))) == 0.0
    assert one(spark, M.safe_sum(m)) == 2.0


def test_threshold_gate(spark):
    assert one(spark, M.passes(F.create_map(F.lit("a"), F.lit(0.4), F.lit("error"), F.lit(9.0)), 0.4))
    assert not one(spark, M.passes(F.create_map().cast("map<string,double>"), 0.4))
    assert not one(spark, M.passes(F.create_map(F.lit("a"), F.lit(float("nan"))), 0.4))


def test_cascade_merge(spark):
    a, b = F.create_map(F.lit("a"), F.lit(1.0), F.lit("error"), F.lit(0.0)), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(3.0))
    assert one(spark, M.merged(a, b)) == {"a": 2.0, "b": 3.0}


@pytest.mark.parametrize(("x", "clamped", "raw"), [(0.55, 5, 5), (1.2, 9, 9), (-0.15, 0, -1)])
def test_feature_bin(spark, x, clamped, raw):
    assert one(spark, M.bin_of(F.lit(x), 10)) == clamped
    assert one(spark, M.bin_of(F.lit(x), 10, clamp=False)) == raw


PROGRAM = "id long, code string, parent_id long, generation long, island long, seq long, metrics map<string,double>"


def test_best_of_mixed(spark):
    p = spark.createDataFrame([(1, "", None, 0, 0, 0, {"combined_score": 0.9, "s": 0.1}), (2, "", None, 0, 0, 1, {"s": 0.8})], PROGRAM)
    assert P.best_program(p).first().id == 2
    assert P.best_program(p, "s").first().id == 2
    assert P.best_program(p.where("id = 1")).first().value == 0.9


def test_one_migrant_of_three(spark):
    p = spark.createDataFrame([(i, "", None, 0, 0, i, {"s": i / 10}) for i in range(3)], PROGRAM)
    rows = P.migrants(p, 3, 0.1).collect()
    assert {(r.id, r.target) for r in rows} == {(2, 1), (2, 2)}
    assert len(P.migrants(p, 2, 0.1).collect()) == 1


def test_archive_fold_against_model(spark):
    values = [0.3, 0.1, 0.5, 0.2, 0.9, 0.05, 0.4]
    p = spark.createDataFrame([(i, "", None, 0, 0, i, {"s": v}) for i, v in enumerate(values)], PROGRAM)
    held = []
    for i, v in enumerate(values):
        if len(held) < 3:
            held.append((v, i))
        elif v > min(held)[0]:
            held[held.index(min(held))] = (v, i)
    assert {r.id for r in P.archive_fold(p, 3).collect()} == {i for _, i in held}


def test_limit_keeps_the_protected(spark):
    p = spark.createDataFrame([(i, "", None, 0, 0, i, {"s": i / 10}) for i in range(6)], PROGRAM)
    kept = P.limited(p, 3, 0)
    assert {r.id for r in kept.collect()} == {0, 5, 4}
    members = spark.createDataFrame([(0, 1), (0, 5)], "island long, program_id long")
    assert [r.program_id for r in P.cascade_delete(members, kept).collect()] == [5]


def test_regression(spark):
    rows = [(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 3.0, float("nan")), (1, 4.0, 5.0), (2, 2.0, 2.0), (2, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g long, y double, y_hat double")
    r = {x.g: x for x in E.regression_metrics(df, "g").collect()}
    assert (r[1].n, r[1].mse, r[1].nmse, r[1].r2, r[1].mape) == (3, pytest.approx(1 / 3), pytest.approx(3 / 14), pytest.approx(11 / 14), pytest.approx(1 / 12))
    assert (r[2].nmse, r[2].r2) == (math.inf, -math.inf)
    tau = {x.g: x.tau for x in E.kendall_tau(df.withColumn("k", F.monotonically_increasing_id()), "g", "k").collect()}
    assert tau[1] == pytest.approx(1) and math.isnan(tau[2])


def test_fit_recovers_a_line(spark):
    rows = [(1, [float(i) / 10], 3.0 * i / 10 + 1) for i in range(20)]
    r = E.multi_restart_fit(spark.createDataFrame(rows, "g long, x array<double>, y double"), "g", 1, steps=2000).first()
    assert r.params == pytest.approx([3.0, 1.0], abs=1e-2)


@pytest.mark.parametrize(("text", "size"), [("4K", 4096), ("10", 10), ("4KB", 4096), ("x", None), (" 2MB ", 2 << 20)])
def test_size(spark, text, size):
    assert one(spark, T.size_in_bytes(F.lit(text)).cast("long")) == size


@pytest.mark.parametrize(
    ("method", "a", "b", "same"),
    [("check/integer-match.py", " 42 ", "42", True), ("check/integer-match.py", "42.0", "42", False), ("x", "a\r\nb ", "a\nb", True), ("check/size-match.py", "4KB", "4096", True), ("x", None, "a", False)],
)
def test_answers(spark, method, a, b, same):
    assert one(spark, T.answers_match(F.lit(method), F.lit(a).cast("string"), F.lit(b))) is same


def test_texts(spark):
    assert one(spark, T.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, T.truncated_at(F.lit("abXcdY"), F.array(F.lit("Y"), F.lit("X")))) == "abXcd"
    assert one(spark, T.safe_mkdir(F.lit("mkdir a; mkdir -p b"))) == "mkdir -p a; mkdir -p b"
    s = one(spark, T.judge_summary(F.lit("Score: 5\nTest cases done: 3\nTest cases correct: 2\nTest cases total: 4")))
    assert tuple(s) == (5, 3, 2, 4)
    assert one(spark, T.redacted(F.lit("x" * 40))) == "<REDACTED_TOKEN>"
    assert one(spark, T.tag(F.lit("a <t> 1 </t> <t>2</t>"), "t")) == " 1 "
    assert one(spark, T.strip(F.lit("\u00a0 a\u2003\n"))) == "a"
    assert one(spark, T.braces(F.lit("x {1} y } z"))) == "{1} y }"
    assert "\ufffd" in one(spark, T.decoded(F.unhex(F.lit("FFFEFD"))))
    section = one(spark, T.artifact_section(F.lit("log"), F.lit("This is a very long log message. " * 700), 20480))
    assert "(truncated)" in section and len(section) < 20600
    starter = one(spark, T.starter_code(F.lit("class A:\n    def f(self):")))
    assert starter.endswith("\n        ")


CODE = "import x\n\ndef f():\n    a = 1\n    y = 2\n    return a"
DIFF = "<<<<<<< SEARCH\n    a = 1\n=======\n    a = 3\n>>>>>>> REPLACE\ntext\n<<<<<<< SEARCH\n    return a\n=======\n    return y\n>>>>>>> REPLACE"


def test_diffs(spark):
    blocks = one(spark, T.diff_blocks(F.lit(DIFF)))
    assert [(b.search, b.replace) for b in blocks] == [("    a = 1", "    a = 3"), ("    return a", "    return y")]
    assert one(spark, T.apply_blocks(F.lit(CODE), T.diff_blocks(F.lit(DIFF)))) == CODE.replace("a = 1", "a = 3").replace("return a", "return y")
    assert one(spark, T.apply_blocks(F.lit(CODE), T.diff_blocks(F.lit(DIFF.replace("a = 1", "zz"))))) == CODE.replace("return a", "return y")


def test_tolerant_json():
    assert T.tolerant_json('```json\n{"a": 1}\n```\n```json\n{"a": 2}\n```') == ('{"a": 2}', None)
    assert T.tolerant_json('```json\n{"a": 2 // x\n}\n```')[0] == '{"a": 2}'
    assert T.tolerant_json("```json\n{'a': True}\n```")[0] == '{"a": true}'
    assert T.tolerant_json("none")[0] is None
    assert T.tolerant_json("```json\n__import__('os')\n```")[0] is None


def test_templates(spark):
    text = "### Query:\n do it \n\n### Init:\nnone\n\n### Type:\nQA\n\n### Comparison_method:\nm.py\n\nrest"
    names = ("Query", "Init", "Type", "Comparison_method")
    assert tuple(one(spark, T.template_fields(F.lit(text), names))) == ("do it", "none", "QA", "m.py")
    assert one(spark, T.template_fields(F.lit("### Query: x"), names)) is None


def test_packing(spark):
    c = spark.createDataFrame([(1, 0, 0.2, 0.5, 0.2), (1, 1, 0.5, 0.5, 0.2), (1, 2, 0.95, 0.5, 0.1)], "grp long, idx long, x double, y double, r double")
    assert [(r.i, r.j) for r in G.overlaps(c).collect()] == [(0, 1)] == [(r.i, r.j) for r in G.overlaps(c, cell=0.5).collect()]
    assert [r.idx for r in G.boundary_violations(c).collect()] == [2]
    s = G.packing_scores(c).first()
    assert (s.valid, s.overlaps, s.boundary, s.target_ratio) == (False, 1, 1, 0.0)
    repaired = G.repaired_radii(c)
    assert G.packing_scores(repaired).first().valid


def test_instances(spark):
    rows = [("a", "QA", None), ("b", "QA", "x"), ("c", "EXEC", "x"), ("d", "EXEC", None), ("e", None, "x")]
    out = V.valid_instances(spark.createDataFrame(rows, "id string, type string, get_agent_result string"))
    assert {r.id: r.type for r in out.collect()} == {"a": "QA", "b": "WRONG", "c": "EXEC", "d": "WRONG", "e": "WRONG"}


def test_sets_and_samples(spark):
    d = spark.range(100)
    assert R.sampled(d, 10, "id", "s").collect() == R.sampled(d, 10, "id", "s").collect()
    assert R.unfinished(d, d.where("id < 90"), "id").count() == 10
    assert [r.idx for r in R.numbered_all(d, "id").orderBy("id").collect()] == list(range(100))
    models = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "model string, weight double")
    assert {r.model for r in R.weighted_choice(d, models, "id", "w").collect()} == {"b"}
    three = spark.createDataFrame([(m, 0.3) for m in "abc"], "model string, weight double")
    assert {r.model for r in R.weighted_choice(spark.range(1000), three, "id", "w").collect()} == set("abc")


def test_ranks_and_maxima_over_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(i, 1 if i % 10 else 2 + i % 3, float(rng.randrange(50))) for i in range(400)] + [(400, None, 1.0)]
    d = spark.createDataFrame(rows, "seq long, g long, v double").repartition(3)
    got = {r.seq: r["rank"] for r in R.ranked_within(d, "g", F.desc("v"), "seq").collect()}
    best = {r.seq: r.m for r in R.so_far(d, "g", "seq", "v", "m").collect()}
    for g in {g for _, g, _ in rows}:
        own = [(s, v) for s, h, v in rows if h == g]
        assert [s for s, _ in sorted(own, key=lambda x: (-x[1], x[0]))] == sorted((s for s, _ in own), key=got.get)
        assert sorted(got[s] for s, _ in own) == list(range(1, len(own) + 1))
        assert [best[s] for s, _ in own] == [max((v for _, v in own[:k]), default=None) for k in range(len(own))]
